"""Messages about events, kept in line with a stream of revised readings.

An event is an instrument's time span of SPAN. Its readings come as revisions: an hour's size as a run finds it, null where the hour holds no reading
any more. The state of an event is what its messages show and what it has read so far; only a new hour brings a new message:

- a new hour rarer in word than what is shown goes out as a message of its own (`post`), and the message before stays as it was;
- a new hour larger in the same word moves the numbers in place (`edit`);
- whatever changes about a past hour corrects the message that shows it (`correct`), or takes the largest hour left in its place;
- a message whose hour is gone, with no other past hour left, is struck (`strike`); earlier messages follow their own hour alone;
- an event ends when the watermark of event ends passes it (`expire`), and its state is dropped; revisions after that are too late.

An hour is new if it was never read before and had not ended by the run before; an event without a new hour is never opened."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import ship
from .events import run_to_table

#: Words by size, seconds of an hour.
WORDS = (("notable", 60.0), ("large", 90.0), ("rare", 120.0), ("extreme", 180.0))
HOUR = 3600
#: Seconds of an event, and of a run of the replay.
SPAN, RUN = 10 * 86_400, 96 * HOUR
#: How far event ends may lag behind the newest before an event expires.
KEEP = "120 hours"
#: Columns of a revision; ends is the event's end as a timestamp, clock the newest tick of the runs before (null in the first).
REVISIONS = "asset string, event long, hour long, size double, run long, clock long, ends timestamp"
ACTIONS = "asset string, event long, run long, action string, hour long, size double, word string"


def rank(size: float) -> int:
    return sum(size > level for _, level in WORDS)


def word(size: float | None) -> str | None:
    return None if size is None or not rank(size) else WORDS[rank(size) - 1][0]


def _largest(sizes: dict[int, float]) -> tuple[int, float] | None:
    """The hour of the largest size; of equal ones the earliest."""
    return max(sizes.items(), key=lambda x: (x[1], -x[0]), default=None)


@dataclass
class Event:
    """What an event's messages show: the current one (hour, size, struck), earlier ones, and all hours read so far (null: gone)."""

    shown: tuple[int, float, bool] | None = None
    earlier: list[tuple[int, float, bool]] = field(default_factory=list)
    read: dict[int, float | None] = field(default_factory=dict)
    seen: set[int] = field(default_factory=set)  # hours that held a reading at any run

    def advance(self, revised: dict[int, float | None], clock: int | None) -> list[tuple[str, int, float]]:
        """The actions of one run, in order: (action, hour, size)."""
        acts: list[tuple[str, int, float]] = []
        before = self.read
        self.read = before | revised
        held = {h: s for h, s in self.read.items() if s is not None}
        new = {h: s for h, s in held.items() if h not in self.seen and (clock is None or h + HOUR > clock)}
        self.seen |= held.keys()
        for n, (hour, size, struck) in enumerate(self.earlier):
            now = held.get(hour)
            if now is None and not struck:
                self.earlier[n] = (hour, size, True)
                acts.append(("strike", hour, size))
            elif now is not None and (struck or now != size):
                self.earlier[n] = (hour, now, False)
                acts.append(("correct", hour, now))
        if self.shown is None:
            if new:
                hour, size = _largest(held)
                self.shown = (hour, size, False)
                acts.append(("post", hour, size))
            return acts
        hour, size, struck = self.shown
        past = {h: s for h, s in held.items() if h not in new}
        display, data = (hour, held[hour]) if hour in held else _largest(past), hour not in held or struck or held[hour] != size
        late = {h: s for h, s in past.items() if h in revised and h != hour and s != before.get(h) and s > (display[1] if display else size)}
        if late:
            display, data = _largest(late), True
        if display is None and not struck:
            struck = True
            acts.append(("strike", hour, size))
        elif display is not None and data:
            (hour, size), struck = display, False
            acts.append(("correct", hour, size))
        top = _largest({h: s for h, s in new.items() if s > size or struck})
        if top is not None:
            rarer = struck or rank(top[1]) > rank(size)
            if rarer:
                self.earlier.append((hour, size, struck))
            (hour, size), struck = top, False
            acts.append(("post" if rarer else "edit", hour, size))
        self.shown = (hour, size, struck)
        return acts


class Messages(StatefulProcessor):
    """Keyed by (asset, event): a value for the message shown, maps for the hours read and the earlier messages, a timer for the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "hour long, size double, struck boolean")
        self.hours = handle.getMapState("hours", "hour long", "size double, seen boolean")
        self.parts = handle.getMapState("parts", "nth long", "hour long, size double, struck boolean")

    def _load(self) -> Event:
        shown = self.shown.get() if self.shown.exists() else None
        hours = {k[0]: tuple(v) for k, v in self.hours.iterator()} if self.hours.exists() else {}
        parts = sorted((k[0], tuple(v)) for k, v in self.parts.iterator()) if self.parts.exists() else []
        return Event(tuple(shown) if shown is not None else None, [v for _, v in parts], {h: s for h, (s, _) in hours.items()}, {h for h, (_, e) in hours.items() if e})

    def _save(self, e: Event, revised: set[int], parts: list) -> None:
        if e.shown is not None:
            self.shown.update(e.shown)
        for h in revised:
            self.hours.updateValue((h,), (e.read[h], h in e.seen))
        for n, part in enumerate(e.earlier):
            if n >= len(parts) or parts[n] != part:
                self.parts.updateValue((n,), part)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((int(key[1]) + 1) * SPAN * 1000)
        e = self._load()
        parts, out = list(e.earlier), []
        for run, group in told.groupby("run"):
            revised = {int(h): None if pd.isna(s) else float(s) for h, s in zip(group["hour"], group["size"], strict=True)}
            clock = None if group["clock"].isna().any() else int(group["clock"].iloc[0])
            out += [(*key, int(run), a, h, s, word(s)) for a, h, s in e.advance(revised, clock)]
        self._save(e, {int(h) for h in told["hour"]}, parts)
        yield _actions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shown = self.shown.get() if self.shown.exists() else None
        for state in (self.shown, self.hours, self.parts):
            state.clear()
        yield _actions([(*key, None, "expire", shown[0], shown[1], word(shown[1]))] if shown is not None else [])

    def close(self) -> None:
        pass


def _actions(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in ACTIONS.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"event": "int64", "run": "Int64", "hour": "int64", "size": "float64"})


def actions(revisions: DataFrame, keep: str = KEEP) -> DataFrame:
    """The actions of a stream of revisions (REVISIONS), as a table. Runs come one after another; events live as long as `keep` says."""
    spark = revisions.sparkSession
    ship(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = revisions.withWatermark("ends", keep).groupBy("asset", "event").transformWithStateInPandas(
            statefulProcessor=Messages(), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime",
        )
        return run_to_table(told, "append")
    finally:
        spark.conf.set(name, was)


def revised(ticks: DataFrame) -> DataFrame:
    """REVISIONS of ticks (asset, event_id, t, price, run): an hour's size is its last price so far, a reading above the lowest word's level."""
    hour = (F.floor(F.col("t") / HOUR) * HOUR).alias("hour")
    last = ticks.groupBy("asset", hour, "run").agg(F.max(F.struct("event_id", "price")).alias("last"), F.max("t").alias("newest"))
    clock = F.max("newest").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = last.groupBy("run").agg(F.max("newest").alias("newest")).select("run", clock.alias("clock"))  # a row a run
    price = F.max("last").over(Window.partitionBy("asset", "hour").orderBy("run"))["price"]
    event = F.floor(F.col("hour") / SPAN)
    sizes = last.select(
        "asset", "hour", "run", F.when(price > WORDS[0][1], price).alias("size"), event.alias("event"), F.timestamp_seconds((event + 1) * SPAN).alias("ends"),
    )
    return sizes.join(F.broadcast(runs), "run").select(*(x.split()[0] for x in REVISIONS.split(", ")))
