"""Window tools that Spark's functions don't give at once.

Folds and trailing windows in Python read a sorted partition Arrow batch by Arrow batch and keep only a state or the last
rows of one key, so a key of any length takes bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def range_mean(x: Column | str, at: str, keys: list[str], seconds: int, least: int, wide: bool = False) -> Column:
    """Mean of x over [at - seconds, at), null with fewer than `least` values.

    A sliding frame would be summed anew at each row; the difference of two running sums costs one step a row. The sums are
    decimals of 22 places, so a small window late in a long series keeps its digits. Values of 10^8 and more need `wide`, which sums whole
    parts and fractions apart (up to 10^28)."""
    x = F.col(x) if isinstance(x, str) else x
    parts = [(x, "decimal(30,22)", "decimal(38,22)")]
    if wide:
        parts = [(x - F.floor(x), *parts[0][1:]), (F.floor(x), "decimal(38,0)", "decimal(38,0)")]
    w = Window.partitionBy(*keys).orderBy(at)
    upto, before = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(Window.unboundedPreceding, -seconds - 1)
    n = F.count(x).over(upto) - F.count(x).over(before)

    def total(part: Column, kind: str, sums: str) -> Column:
        zero = F.lit(0).cast(sums)
        return (F.coalesce(F.sum(part.cast(kind)).over(upto), zero) - F.coalesce(F.sum(part.cast(kind)).over(before), zero)).cast("double")

    return F.when(n >= least, sum((total(*p) for p in parts[1:]), total(*parts[0])) / n)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], bin_size: int | None = None,
) -> DataFrame:
    """Each left row with the values of the last right row at or before it.

    Both sides are one stream in time order and a running last value is carried on: one shuffle, no range join. With bin_size, the
    time line of each key is cut into bins of that length, which are tasks of their own; the value that a bin opens with comes
    from the last right rows of the bins before, one row a bin."""
    if bin_size:
        left = left.withColumn("_bin", F.floor(F.col(left_at) / bin_size))
        right = right.withColumn("_bin", F.floor(F.col(right_at) / bin_size))
        kept = [F.col(v) for v in values]
        last = right.groupBy(*keys, "_bin").agg(F.max_by(F.struct(*kept), right_at).alias("_v"))
        bins = left.select(*keys, "_bin").distinct().withColumn("_v", F.lit(None).cast(dict(last.dtypes)["_v"]))
        line = Window.partitionBy(*keys).orderBy("_bin").rangeBetween(Window.unboundedPreceding, -1)
        opens = bins.withColumn("_asked", F.lit(True)).unionByName(last.withColumn("_asked", F.lit(False)))
        opens = opens.withColumn("_open", F.last("_v", ignorenulls=True).over(line)).where(F.col("_asked") & F.col("_open").isNotNull())
        start = (F.col("_bin") * bin_size - 1).cast(dict(right.dtypes)[right_at]).alias(right_at)
        right = (
            right.select(*keys, "_bin", right_at, *values)
            .unionByName(opens.select(*keys, "_bin", start, *[F.col("_open")[v].alias(v) for v in values]))
        )
        return asof_backward(left, right, [*keys, "_bin"], left_at, right_at, values).drop("_bin")
    right_cols = [F.col(v).alias(f"_r_{v}") for v in values]
    empty = [F.lit(None).cast(dict(right.dtypes)[v]).alias(f"_r_{v}") for v in values]
    a = left.select(*left.columns, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), *empty, F.lit(None).cast("boolean").alias("_has"))
    same = [F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    b = right.select(*same, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), *right_cols, F.lit(True).alias("_has"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_has"), F.struct(*[f"_r_{v}" for v in values])), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_v", carried).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_v._r_{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the first right row strictly after it."""
    flip = lambda df, at: df.withColumn("_neg", -F.col(at) - (0 if df is left else -1))
    return asof_backward(flip(left, left_at), flip(right, right_at), keys, "_neg", "_neg", values).drop("_neg")


def last_rows(rows: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def counts_before(rows: DataFrame, key: str) -> DataFrame:
    """key, before: how many rows the smaller keys have. One row a key is summed along the keys."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return n.select(key, F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("before"))


def earlier_at_least(
    rows: DataFrame, keys: list[str], at: str, value: Column, least: Column, carry: list[str], points: DataFrame | None = None, upto: bool = False,
) -> DataFrame:
    """rows with _n, the number of earlier rows of their key whose value is `least` or more, and the `carry` columns of the last
    of them in the struct _last. (keys, at) names a row. Earlier rows are those of `points` (rows themselves if None), before `at` or, with
    `upto`, at it too; rows and points both give value and least.

    Values and bounds are ranked together within the key; the ranks above a bound are a few blocks of lengths that are powers of two, and each
    value lies in one block of each length, so a lookup is a running count and a running last within its blocks: no row is paired with all before it."""
    points = rows if points is None else points
    asked = rows.select(
        *keys, F.col(at).alias("_at"), least.cast("double").alias("_v"), F.lit(0).alias("_side"),
        F.lit(None).cast(f"struct<{','.join(f'{n}:{t}' for n, t in points.dtypes if n in carry)}>").alias("_row")
    )
    held = points.select(
        *keys, F.col(at).alias("_at"), value.cast("double").alias("_v"), F.lit(1).alias("_side"),
        F.struct(*[n for n in points.columns if n in carry]).alias("_row")
    )
    both = asked.unionByName(held).where(F.col("_v").isNotNull())
    key = Window.partitionBy(*keys)
    ranked = (
        both.withColumn("_rank", F.row_number().over(key.orderBy("_v", "_side")) - 1)
        .withColumn("_bits", F.ceil(F.log2(F.count(F.lit(1)).over(key) + 1)).cast("int"))
    )
    cut = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_bits")))).withColumn("_block", F.expr("shiftright(_rank, _level)"))
    # a bound looks into the block to the right of its own where its own is a left one; values matter only in right ones
    odd = F.col("_block") % 2 == 1
    cut = cut.where(F.when(F.col("_side") == 1, odd).otherwise(~odd)).withColumn("_block", F.col("_block") + (F.col("_side") == 0).cast("int"))
    first = F.col("_side") if not upto else -F.col("_side")
    line = Window.partitionBy(*keys, "_level", "_block").orderBy("_at", first).rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        cut.withColumn("_c", F.count("_row").over(line))
        .withColumn("_l", F.last(F.when(F.col("_side") == 1, F.struct("_at", "_row")), ignorenulls=True).over(line))
    )
    found = seen.where("_side = 0").groupBy(*keys, "_at").agg(F.sum("_c").alias("_n"), F.max_by("_l", "_l._at").alias("_l"))
    found = found.select(*keys, F.col("_at").alias(at), "_n", F.col("_l._row").alias("_last"))
    return rows.join(found, [*keys, at], "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))


def _added(adds: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in adds.split(", ")]


def _sorted(rows: DataFrame, keys: list[str], at: str, adds: str) -> tuple[DataFrame, T.StructType]:
    ship(rows.sparkSession)
    more = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _added(adds)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, at), T.StructType([*rows.schema.fields, *more.fields])


def _with(batch: pa.RecordBatch, adds: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in _added(adds))])


def folded(rows: DataFrame, keys: list[str], at: str, reads: list[str], step: Callable, start: Callable, adds: str) -> DataFrame:
    """rows with the columns of adds ("name type, ..."), made by `step(state, *reads) -> (state, values)` in the order of `at` within
    each key, from the state `start()`."""
    names, kinds = rows.columns, [_ARROW[t] for _, t in _added(adds)]
    places = [names.index(n) for n in (*keys, *reads)]
    parted, schema = _sorted(rows, keys, at, adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for values in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if (now := values[: len(keys)]) != key:
                    key, state = now, start()
                state, out = step(state, *values[len(keys) :])
                made.append(out)
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            yield _with(batch, adds, [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)])

    return parted.mapInArrow(run, schema)


def trailing(rows: DataFrame, keys: list[str], at: str, x: str, span: int, compute: Callable[[np.ndarray], list[np.ndarray]], adds: str) -> DataFrame:
    """rows with the double columns of adds: compute takes a row of the `span` values of x before each row (nan where there is none)
    and gives an array a column (nan: null)."""
    names = rows.columns
    places, of = [names.index(k) for k in keys], names.index(x)
    parted, schema = _sorted(rows, keys, at, adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(of).cast(pa.float64()).to_numpy(zero_copy_only=False)
            named = list(zip(*(batch.column(i).to_pylist() for i in places), strict=True))
            heads = [i for i in range(len(named)) if i == 0 or named[i] != named[i - 1]]
            parts = []
            for i, j in zip(heads, [*heads[1:], len(named)], strict=True):
                if named[i] != key:
                    key, before = named[i], np.full(span, np.nan)
                line = np.concatenate((before, values[i:j]))
                for a in range(0, j - i, 4096):  # a few MB of windows at once
                    b = min(a + 4096, j - i)
                    parts.append(compute(np.lib.stride_tricks.sliding_window_view(line[a : b + span - 1], span)))
                before = line[-span:]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield _with(batch, adds, [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in columns])

    return parted.mapInArrow(run, schema)


def quantiles(windows: np.ndarray, shares: tuple[float, ...], least: int) -> list[np.ndarray]:
    """Interpolated quantiles of each row of windows; nan with fewer than `least` values."""
    ordered, n = np.sort(windows, axis=1), (~np.isnan(windows)).sum(axis=1)
    out = []
    for share in shares:
        place = np.maximum(n - 1, 0) * share
        lo = np.floor(place).astype(int)
        hi = np.minimum(lo + 1, np.maximum(n - 1, 0))
        rows = np.arange(len(ordered))
        a, b = ordered[rows, lo], ordered[rows, hi]
        out.append(np.where(n >= max(least, 1), a + (b - a) * (place - lo), np.nan))
    return out


def event_starts(rows: DataFrame, key: str, at: str, span: int, anchors: DataFrame | None = None) -> DataFrame:
    """rows with event_start. An event lasts `span` from its first row; what lies within belongs to it and doesn't lengthen it.

    anchors (key, anchor) are starts that are fixed: rows within `span` from one belong to it (the earliest, where several do), by a join on bins of
    the time. The other rows are dealt out in order; one that would begin an event, but lies at most `span` before an anchor, joins that."""
    if anchors is None:
        free = rows.withColumn("_ahead", F.lit(None).cast("bigint"))
        pinned = None
    else:
        bin_of = lambda c: F.floor(c / span)
        spread = anchors.select(key, "anchor", F.explode(F.array(*(bin_of(F.col("anchor")) + i for i in (-1, 0, 1)))).alias("_bin"))
        met = rows.select(key, at).distinct().withColumn("_bin", bin_of(F.col(at))).join(spread, [key, "_bin"]).groupBy(key, at).agg(
            F.min(F.when(F.col(at).between(F.col("anchor"), F.col("anchor") + span - 1), F.col("anchor"))).alias("_held"),
            F.min(F.when(F.col("anchor").between(F.col(at) + 1, F.col(at) + span), F.col("anchor"))).alias("_ahead"),
        )
        told = rows.join(met, [key, at], "left")
        pinned = told.where("_held is not null").withColumn("event_start", F.col("_held")).select(*rows.columns, "event_start")
        free = told.where("_held is null").select(*rows.columns, "_ahead")

    def step(start, now, ahead):
        if start is not None and now - start < span:
            return start, (start,)
        return (start, (ahead,)) if ahead is not None else (now, (now,))

    out = folded(free, [key], at, [at, "_ahead"], step, lambda: None, "event_start bigint").drop("_ahead")
    return out if pinned is None else out.unionByName(pinned)
