"""Windows along a key's time line, cut into blocks of time that are tasks of their own.

A window by key alone is one task a key, however long the key's history. Here rows are dealt by (key, block of time), in one of three ways:
`dealt` gives each block the rows before it that a window of bounded reach can see; `running` carries sums from block to block by a scan over one
summary row a block; `last_at_least` looks up in the own block first, then among one row a block. So the work of a key is spread over as
many tasks as it has blocks, and what runs by key alone are rows of blocks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .windows import folded

#: Seconds of a block where no reach sets it.
BLOCK = 30 * 86_400
#: Units (of the reach, or BLOCK) in a block: a block's rows and those of one unit before it are a task's.
SPAN = 4


def dealt(
    rows: DataFrame, keys: list[str], at: str, reach: int, before: int, compute: Callable[[DataFrame, list[str]], DataFrame],
    unit: int | None = None, span: int = SPAN,
) -> DataFrame:
    """compute(rows, keys) by blocks of time: the same rows as over whole keys, if a row depends on rows up to `reach` seconds before it, and those on
    `before` rows before them at most.

    compute gets keys with the block among them and rows with two columns more, which it keeps; its windows are by these keys. A block's task
    gets its own rows, those of one unit before it (a unit is `reach` or more, a block `span` units, so this copies one row in `span`), and the
    last `before` rows before those, however long ago: they come from a scan over the last rows of each unit. (keys, at) names a row;
    null keys are keys."""
    unit = max(unit or (reach if reach else BLOCK), reach, 1)
    ahead = 1 if reach else 0
    cut = rows.withColumn("_unit", F.floor(F.col(at) / unit))
    own = F.floor(F.col("_unit") / span)
    spread = cut.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_unit") + ahead) / span))))
    spread = spread.withColumn("_own", F.col("_block") == own)
    # the last rows up to the end of each unit, and of those the ones before each block's first unit
    whole = F.struct(F.col(at).alias("_at"), F.struct(*(F.col(n) for n in rows.columns)).alias("_row"))
    last = cut.groupBy(*keys, "_unit").agg(F.slice(F.sort_array(F.collect_list(whole), asc=False), 1, before).alias("_last")) if before > 1 else (
        cut.groupBy(*keys, "_unit").agg(F.array(F.max_by(whole, at)).alias("_last"))
    )
    line = Window.partitionBy(*keys).orderBy(F.desc("_unit"))
    ends = last.withColumn("_last", F.slice(F.flatten(F.collect_list("_last").over(line.rowsBetween(0, before - 1))), 1, before))
    asked = last.select(*keys, F.floor(F.col("_unit") / span).alias("_block")).distinct()
    asked = asked.select(*keys, (F.col("_block") * span - ahead).alias("_unit"), F.lit(None).cast(dict(ends.dtypes)["_last"]).alias("_last"), "_block")
    both = ends.withColumn("_block", F.lit(None).cast("bigint")).unionByName(asked)
    upto = Window.partitionBy(*keys).orderBy("_unit", F.col("_block").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("_last", F.last("_last", ignorenulls=True).over(upto)).where(F.col("_block").isNotNull())
    carried = told.select("_block", F.explode("_last").alias("_r")).select("_r._row.*", "_block", F.lit(False).alias("_own"))
    done = compute(spread.drop("_unit").unionByName(carried), [*keys, "_block"])
    return done.where("_own").drop("_own", "_block")


def _block(at: Column | str, block: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / block).alias("_block")


def _scan(keys: list[str]) -> Window:
    """The blocks of a key before each."""
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with columns `sums` (name to measure): the sum of a measure up to each row, itself included. (keys, at) names a row.

    A sum is null as long as all its measures are."""
    cut = rows.withColumns({"_block": _block(at, block)} | {f"_m_{n}": x for n, x in sums.items()})
    line = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    of = cut.groupBy(*keys, "_block").agg(*(F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums))
    names = [*keys, "_block"]
    opens = of.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), *(F.sum(f"_t_{n}").over(_scan(keys)).alias(f"_o_{n}") for n in sums))
    own = {n: F.sum(f"_m_{n}").over(line) for n in sums}
    out = cut.join(opens, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)], "left")
    either = {n: F.coalesce(own[n] + F.col(f"_o_{n}"), own[n], F.col(f"_o_{n}")).alias(n) for n in sums}
    return out.select(*rows.columns, *either.values())


def ewm(rows: DataFrame, keys: list[str], at: str, columns: list[str], alpha: float, block: int = BLOCK) -> DataFrame:
    """rows with each column smoothed along the key (name to name_ewm): y = alpha x + (1 - alpha) y of the row before, from y = x of the first. Null x
    leave y as it is. (keys, at) names a row.

    A step is an affine map of the y before, and so is any run of steps: each block composes its own from its rows (two numbers a row), the
    blocks' maps are folded over one row a block, and each row applies its map to the y that its block opens with."""
    names = [*keys, "_block"]
    kinds = [f"{p}{i}" for i in range(len(columns)) for p in ("_a", "_b", "_y")]  # y is a y0 + b; _y where nothing comes before

    def step(state, *xs):
        out = []
        for x, (a, b, y) in zip(xs, state, strict=True):
            if x is not None:
                a, b, y = a * (1 - alpha), b * (1 - alpha) + alpha * x, x if y is None else y * (1 - alpha) + alpha * x
            out.append((a, b, y))
        return tuple(out), tuple(v for t in out for v in t)

    maps = stage(
        folded(rows.withColumn("_block", _block(at, block)), names, at, columns, step, lambda: ((1.0, 0.0, None),) * len(columns), ", ".join(f"{n} double" for n in kinds)),
        "maps",
    )
    ends = maps.groupBy(*names).agg(F.max_by(F.struct(*kinds), at).alias("_end")).select(*names, "_end.*")

    def chain(state, *values):
        """state: the y of each column before the block."""
        after = []
        for i, y0 in enumerate(state):
            a, b, y = values[3 * i : 3 * i + 3]
            after.append(y if y0 is None else a * y0 + b)
        return tuple(after), state

    opens = folded(ends, keys, "_block", kinds, chain, lambda: (None,) * len(columns), ", ".join(f"_o{i} double" for i in range(len(columns))))
    told = opens.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), *(f"_o{i}" for i in range(len(columns))))
    out = maps.join(told, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)], "left")
    y = lambda i: F.coalesce(F.col(f"_a{i}") * F.col(f"_o{i}") + F.col(f"_b{i}"), F.col(f"_y{i}"))
    return out.select(*rows.columns, *(y(i).alias(f"{n}_ewm") for i, n in enumerate(columns)))


def _heights():
    """State of a lookup: heights that fall from the oldest to the newest (as negatives, ascending), and their times."""
    return [], []


def _lookup(state, now, height, least):
    """The last earlier time of a height of `least` or more, and that height; then the row's own height is put on top."""
    falling, times = state
    n = bisect_right(falling, -least) if least is not None else 0
    found = (times[n - 1], -falling[n - 1]) if n else (None, None)
    if height is not None:
        while falling and falling[-1] >= -height:  # a newer one as large hides it
            falling.pop()
            times.pop()
        falling.append(-height)
        times.append(now)
    return state, found


def last_at_least(rows: DataFrame, keys: list[str], at: str, value: Column, least: Column, block: int = BLOCK) -> DataFrame:
    """rows with since (bigint) and since_value: time and value of the last earlier row of their keys whose value is `least` or more; null where there is
    none, or least is null. (keys, at) names a row.

    Most lookups end in their own block. The others are set against one row a block, its largest value, to find the block of their
    answer, and then against the rows of that block. Each step is a fold over sorted rows whose state is a falling staircase of heights."""
    cut = stage(rows.withColumns({"_block": _block(at, block), "_v": value.cast("double"), "_w": least.cast("double")}), "heights")
    near = stage(folded(cut, [*keys, "_block"], at, [at, "_v", "_w"], _lookup, _heights, "since bigint, since_value double"), "own-blocks")
    open_ = F.col("_w").isNotNull() & F.col("since").isNull()
    asked = near.where(open_).select(*keys, "_block", F.col(at).alias("_at"), "_w")
    tops = cut.groupBy(*keys, "_block").agg(F.max("_v").alias("_v"))
    empty = lambda kind: F.lit(None).cast(kind)
    # of a block's lines, those that ask come before its own height
    line = asked.select(*keys, "_block", (F.col("_block") * 2).alias("_order"), "_at", empty("double").alias("_v"), "_w")
    line = line.unionByName(
        tops.select(*keys, "_block", (F.col("_block") * 2 + 1).alias("_order"), empty("bigint").alias("_at"), "_v", empty("double").alias("_w")),
    )
    there = folded(line, keys, "_order", ["_block", "_v", "_w"], _lookup, _heights, "_where bigint, _top double").where("_where is not null")
    # the rows of the blocks found, then those that ask, after all of them
    ask = there.select(*keys, F.col("_where").alias("_block"), F.lit((1 << 63) - 1).alias("_order"), "_at", empty("double").alias("_v"), "_w")
    wanted = ask.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_block")))).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_block"))]
    held = cut.join(wanted, same, "left_semi").select(
        *keys, "_block", F.col(at).cast("bigint").alias("_order"), empty("bigint").alias("_at"), "_v", empty("double").alias("_w"),
    )
    got = folded(held.unionByName(ask), [*keys, "_block"], "_order", ["_order", "_v", "_w"], _lookup, _heights, "_since bigint, _height double")
    got = got.where(F.col("_at").isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_at"))), "_since", "_height")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, at))]
    out = near.join(got, same, "left")
    return out.select(
        *rows.columns, F.coalesce("since", "_since").alias("since"), F.coalesce("since_value", "_height").alias("since_value"),
    )
