"""The vote of several feeds on a move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jumps import HALF_PI
from .quantiles import exact_quantiles
from .windows import folded, range_mean

#: The share of a move that a feed must show, and the step of a contract switch in basis points.
SHARE = 0.5
ROLL_STEP_BP = 50.0


def candidates(bars: DataFrame, size: float) -> DataFrame:
    """asset, hour, prev_hour, price, prev_close, move of bars that moved `size` or more (in log) from the bar before."""
    w = Window.partitionBy("asset").orderBy("hour")
    b = bars.where(F.least("open", "high", "low", "close") > 0)
    b = b.withColumn("prev_hour", F.lag("hour").over(w)).withColumn("prev_close", F.lag("close").over(w))
    b = b.withColumn("move", F.ln(F.col("close") / F.col("prev_close"))).where(F.abs("move") >= size)
    return b.select("asset", "hour", "prev_hour", F.col("close").alias("price"), "prev_close", "move")


def far_readings(rows: DataFrame, keys: list[str], r: str, seconds: int, least: int, line: float, doubt: str = "doubt") -> DataFrame:
    """rows with z_raw, z_corrected, candidate: readings of `line` yardsticks or more, by the yardstick of all readings, or by the one without those that
    a vote found untrue (`doubt`, boolean).

    A doubted reading is also set against the yardstick that leaves out the other doubts but not itself, or its vote would vanish the
    count after it was taken. Its yardstick is of products stamped before it, and with it back in, only the products at it and after it
    change: so that yardstick is the mean of the corrected products before it, and each doubt costs a lookup, not a recount."""
    line_of = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    true = F.when(~F.coalesce(F.col(doubt), F.lit(False)), F.col(r))

    def products(x: Column) -> Column:
        return F.abs(x) * F.abs(F.last(x, ignorenulls=True).over(line_of))

    made = rows.withColumns({"_raw": products(F.col(r)), "_true": products(true)})
    z = lambda x: F.col(r) / F.sqrt(F.lit(HALF_PI) * F.when(range_mean(x, "hour", keys, seconds, least) > 0, range_mean(x, "hour", keys, seconds, least)))
    made = made.withColumns({"z_raw": z("_raw"), "z_corrected": z("_true")}).drop("_raw", "_true")
    far = F.coalesce(F.abs("z_raw") >= line, F.lit(False)) | F.coalesce(F.abs("z_corrected") >= line, F.lit(False))
    return made.withColumn("candidate", far)


def judge(cands: DataFrame, feeds: DataFrame, names: DataFrame, skips: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Each candidate put to every feed of names (feed): its answer and move.

    confirmed: the same way and at least half as far; unconfirmed: not so; unknown: the feed has no price at either end. Feeds are not asked about the
    hours of the day that they skip (skips: feed, skip array). A feed that changed contract within the move (changed: asset, feed, first, the first
    hour after a change) has nothing to say about it: unknown."""
    asked = cands.crossJoin(F.broadcast(names))  # names is a fixed handful of feeds
    if skips is not None:
        of_day = (F.floor(F.col("hour") / 3600) % 24).cast("int")
        asked = asked.join(F.broadcast(skips), "feed", "left").where(~F.coalesce(
            F.array_contains("skip", of_day), F.lit(False),
        )).drop("skip")  # a row a feed
    good = feeds.where((F.col("open") > 0) & (F.col("close") > 0)).select("asset", "feed", F.col("hour").alias("h"), F.col("close").alias("c"))
    end = good.select("asset", "feed", F.col("h").alias("hour"), F.col("c").alias("c1"))
    begin = good.select("asset", "feed", F.col("h").alias("prev_hour"), F.col("c").alias("c0"))
    j = asked.join(end, ["asset", "feed", "hour"], "left").join(begin, ["asset", "feed", "prev_hour"], "left")
    if changed is not None:
        crossed = crosses(asked, changed).withColumn("_crossed", F.lit(True))
        j = j.join(crossed, ["asset", "feed", "hour"], "left").withColumn("c1", F.when(F.col("_crossed").isNull(), F.col("c1")))
    own = F.ln(F.col("c1") / F.col("c0"))
    same = (F.signum(own) == F.signum("move")) & (F.abs(own) >= SHARE * F.abs("move"))
    answer = F.when(own.isNull(), "unknown").when(same, "confirmed").otherwise("unconfirmed")
    return j.select(*cands.columns, "feed", answer.alias("answer"), F.when(own.isNotNull(), own).alias("own_move"))


def retakes(cands: DataFrame, closes: DataFrame, reach: int) -> DataFrame:
    """cands (with hour, found) with nth and at: each vote is taken when it is found (nth 0), and again at each end of a session (closes: day, close_at)
    after that, as long as the sources still serve its hour (`reach` seconds). An equi-join on the days a vote is open."""
    day = lambda c: F.floor(c / 86400)
    open_ = cands.withColumn("day", F.explode(F.sequence(day(F.col("found")), F.greatest(day(F.col("found")), day(F.col("hour") + reach)))))
    met = open_.join(closes.select("day", "close_at"), "day").where((F.col("close_at") > F.col("found")) & (F.col("close_at") <= F.col("hour") + reach))
    again = met.select(*cands.columns, F.col("close_at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("asset", "hour").orderBy("at")).cast("bigint")
    first = cands.select(*cands.columns, F.col("found").alias("at"))
    return first.withColumn("nth", F.lit(0).cast("bigint")).unionByName(again.withColumn("nth", nth))


def recounts(takes: DataFrame, ticks: DataFrame) -> DataFrame:
    """takes (asset, hour, prev_hour, move, nth, at) with verdict, n_yes, n_no and changed: each vote by the ticks (asset, feed, t, event_id, price,
    delivered) that had come when it was taken, and whether that overturns the vote before it."""
    key = ["asset", "hour", "nth"]
    ends = takes.select(*key, "at", F.explode(F.array(*(F.struct(F.lit(i).alias("end"), F.col(c).alias("of")) for i, c in ((0, "prev_hour"), (1, "hour"))))).alias("e"))
    held = ticks.where("price > 0").select("asset", "feed", (F.floor(F.col("t") / 3600) * 3600).alias("of"), "event_id", "price", "delivered")
    known = ends.select(*key, "at", "e.end", "e.of").join(held, ["asset", "of"]).where("delivered <= at")
    last = lambda i: F.max(F.when(F.col("end") == i, F.struct("event_id", "price")))["price"].alias(f"c{i}")
    own = known.groupBy(*key, "feed").agg(last(0), last(1)).withColumn("own", F.ln(F.col("c1") / F.col("c0"))).where("own is not null")
    own = own.join(takes.select(*key, "move"), key)
    same = (F.signum("own") == F.signum("move")) & (F.abs("own") >= SHARE * F.abs("move"))
    n = own.groupBy(*key).agg(F.count_if(same).alias("c"), F.count_if(~same).alias("u"))
    told = takes.join(n, key, "left").na.fill(0, ["c", "u"])
    yes, no = F.col("c") + 1, F.col("u")
    verdict = F.when(F.col("c") + F.col("u") == 0, "uncertain").when(yes > no, "real").when(yes == no, "uncertain").otherwise("not real")
    told = told.select(*takes.columns, verdict.alias("verdict"), yes.alias("n_yes"), no.alias("n_no"))
    before = F.lag("verdict").over(Window.partitionBy("asset", "hour").orderBy("nth"))
    return told.withColumn("changed", F.coalesce(F.col("verdict") != before, F.lit(False)))


def crosses(moves: DataFrame, changed: DataFrame) -> DataFrame:
    """asset, feed, hour of the moves (prev_hour, hour] in which the feed's contract changed: an equi-join on the days that a move touches."""
    day = lambda c: F.floor(F.col(c) / 86400)
    days = moves.select("asset", "feed", "prev_hour", "hour", F.explode(F.sequence(day("prev_hour"), day("hour"))).alias("_d"))
    at = changed.select("asset", "feed", "first", day("first").alias("_d"))
    return days.join(at, ["asset", "feed", "_d"]).where("first > prev_hour and first <= hour").select("asset", "feed", "hour").distinct()


def overnight(judged: DataFrame, least: int = 2) -> DataFrame:
    """asset, hour, night: the median move of the feeds that answered, where `least` of them did."""
    shown = (
        judged.where("own_move is not null").groupBy("asset", "hour").agg(F.percentile("own_move", 0.5).alias("night"), F.count(F.lit(1)).alias("n"))
    )
    return shown.where(F.col("n") >= least).select("asset", "hour", "night")


def tally(judged: DataFrame) -> DataFrame:
    """asset, hour, verdict, n_yes, n_no, feeds, seen. The stored feed is one vote that saw the move; unknown ones don't count.

    Most saw it: real; as many as not, or nobody could say: uncertain; else not real."""
    g = judged.groupBy("asset", "hour").agg(
        F.count_if(F.col("answer") == "confirmed").alias("c"), F.count_if(F.col("answer") == "unconfirmed").alias("u"),
        F.array_join(F.array_sort(F.collect_list(F.col("feed").cast("string"))), ",").alias("feeds"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("answer") == "confirmed", F.col("feed").cast("string")))), ",").alias("seen"),
    )
    yes, no = F.col("c") + 1, F.col("u")
    verdict = F.when(F.col("c") + F.col("u") == 0, "uncertain").when(yes > no, "real").when(yes == no, "uncertain").otherwise("not real")
    return g.select("asset", "hour", verdict.alias("verdict"), yes.alias("n_yes"), no.alias("n_no"), "feeds", "seen")


def switches(store: DataFrame, feeds: DataFrame, session: str, step_bp: float = ROLL_STEP_BP, least: int = 3) -> DataFrame:
    """First hours of the sessions at which a feed's median offset to the store stepped."""
    j = (
        store.select("asset", "hour", session, F.col("close").alias("s")).where("s > 0")
        .join(feeds.where("close > 0").select("asset", "feed", "hour", "close"), ["asset", "hour"])
    )
    by = (
        j.groupBy("asset", "feed", session)
        .agg(F.percentile(F.ln(F.col("close") / F.col("s")), 0.5).alias("off"), F.min("hour").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    w = Window.partitionBy("asset", "feed").orderBy(session)
    return (
        by.withColumn("step", F.abs(F.col("off") - F.lag("off").over(w)) * 1e4).where(F.col("step") >= step_bp)
        .select("asset", "feed", "first", "step")
    )


def alignment(
    store: DataFrame, feed: DataFrame, keys: list[str], least: int = 200, corr: float = 0.90, gap_bp: float = 25.0, worst: int = 3,
) -> DataFrame:
    """keys, n, corr, gap_bp, worst_hours, passes: whether a feed's overlap with the store is close enough to splice it, and the hours of the largest gaps."""
    j = (
        store.select(*keys, "hour", F.col("close").alias("a")).join(feed.select(*keys, "hour", F.col("close").alias("b")), [*keys, "hour"])
        .where("a > 0 and b > 0")
    )
    w = Window.partitionBy(*keys).orderBy("hour")
    gap = F.abs(F.ln(F.col("b") / F.col("a"))) * 1e4
    j = j.withColumn("da", F.ln(F.col("a") / F.lag("a").over(w))).withColumn("db", F.ln(F.col("b") / F.lag("b").over(w))).withColumn("gap", gap)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("gap", 6).desc(), "hour"))
    far = j.withColumn("_nth", nth).where(F.col("_nth") <= worst).groupBy(*keys).agg(F.sort_array(F.collect_list("hour")).alias("worst_hours"))
    middle = exact_quantiles(j, keys, F.col("gap"), [0.5]).select(*keys, F.col("q0").alias("gap_bp"))
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("da", "db").alias("corr")).join(middle, keys).join(far, keys)
    return g.withColumn("passes", F.coalesce((F.col("n") >= least) & (F.col("corr") >= corr) & (F.col("gap_bp") <= gap_bp), F.lit(False)))


#: Seconds a feed must have failed before it is told, between two tellings, and after which a failure that wasn't repeated is forgotten.
FAILING, AGAIN, STALE = 12 * 3600, 86_400, 3 * 86_400


def failures_told(answers: DataFrame, failing: int = FAILING, again: int = AGAIN, stale: int = STALE) -> DataFrame:
    """answers (asset, feed, hour, bad: no answer) with since (the first failure of the spell) and told: whether the feed is named at this hour.

    A failure opens or goes on with a spell, an answer ends it, and a spell not heard of for `stale` is forgotten. A feed is named when it fails, has
    failed for `failing` or more, and wasn't named within `again`."""

    def step(state, hour, bad):
        if not bad:
            return None, (None, False)
        since, last, told = state if state is not None and hour - state[1] <= stale else (hour, hour, None)
        named = hour - since >= failing and (told is None or hour - told >= again)
        return (since, hour, hour if named else told), (since, named)

    return folded(answers, ["asset", "feed"], "hour", ["hour", "bad"], step, lambda: None, "since bigint, told boolean")
