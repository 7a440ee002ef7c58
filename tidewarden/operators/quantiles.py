"""Exact quantiles of groups of any size, by selection instead of sorting.

A group's percentile as an aggregate keeps every distinct value of the group in one task. Here values become whole numbers in the same
order (their bits), and ranks are narrowed down by histograms over ever lower bits: a pass counts the values of each bucket, combined on the
map side, and finds for each rank the bucket that holds it. The passes end when every bucket still asked for holds FINISH values at most, which
are then ranked, or when no bits are left. So a group with all rows costs a row a task and bucket, and two to four scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..sources.staging import stage

#: Bits that are left below a bucket, pass by pass.
SHIFTS = (43, 22, 1, 0)
#: Values of a bucket that are ranked directly.
FINISH = 100_000


def _bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _values(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)


def _mapped(rows: DataFrame, column: str, turn, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """rows with `column` turned by a numpy function."""
    ship(rows.sparkSession)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(turn(b.column(at).to_numpy(zero_copy_only=False)), arrow)
            yield pa.RecordBatch.from_arrays([made if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in rows.schema.fields]))


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of both, null equal to null."""
    told = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), *(c for c in right.columns if c not in on))
    return left.join(told, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(on)]).drop(*(f"_k{i}" for i in range(len(on))))


def _narrowed(asked: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """asked (rest: rank among the values of its bucket) with the narrower bucket of each rank."""
    line = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = counts.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
    inside = (F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_n"))
    keep = [c for c in asked.columns if c not in ("_prefix", "_rest", "_size")]
    return _join(asked, held, on).where(inside).select(*keep, F.col("_bucket").alias("_prefix"), (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("_n").alias("_size"))


def exact_quantiles(rows: DataFrame, keys: list[str], x: Column, shares: list[float], finish: int = FINISH) -> DataFrame:
    """keys, n, q0, q1, ...: number of values of x, and their interpolated quantiles, of each group with any. Null and NaN are no values;
    null keys are keys."""
    if not keys:
        return exact_quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], x, shares, finish).drop("_all")
    value = x.cast("double")
    told = rows.select(*keys, value.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    values = stage(_mapped(told, "_x", _bits, T.LongType(), pa.int64()), "ordered-values")
    shift = SHIFTS[0]
    counts = stage(values.groupBy(*keys, F.shiftright("_x", shift).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")), "buckets")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    place = lambda s: (F.col("n") - 1) * F.lit(float(s))
    ranks = F.array(*(f(place(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil)))
    asked = sizes.select(*keys, "n", F.posexplode(ranks).alias("_id", "_rest"))
    asked = stage(_narrowed(asked, counts, keys), "asked")
    for narrower in SHIFTS[1:]:
        largest = asked.agg(F.max("_size")).first()[0] or 0
        if largest <= finish or shift == 0:
            break
        wanted = asked.select(*keys, "_prefix").distinct()
        inner = _join(values.withColumn("_prefix", F.shiftright("_x", shift)), wanted, [*keys, "_prefix"])
        shift = narrower
        counts = inner.groupBy(*keys, "_prefix", F.shiftright("_x", shift).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        asked = stage(_narrowed(asked, counts, [*keys, "_prefix"]), "asked")
    if shift:
        inner = _join(values.withColumn("_prefix", F.shiftright("_x", shift)), asked.select(*keys, "_prefix").distinct(), [*keys, "_prefix"])
        nth = F.row_number().over(Window.partitionBy(*keys, "_prefix").orderBy("_x")) - 1
        found = _join(asked, inner.withColumn("_rest", nth.cast("bigint")), [*keys, "_prefix", "_rest"]).select(*keys, "n", "_id", "_x")
    else:
        found = asked.select(*keys, "n", "_id", F.col("_prefix").alias("_x"))
    found = _mapped(found, "_x", _values, T.DoubleType(), pa.float64())
    at = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_id", "_x"))).alias("_v"))

    def share(i: int, s: float) -> Column:
        low, high = F.col("_v")[2 * i], F.col("_v")[2 * i + 1]
        return (low + (high - low) * (place(s) - F.floor(place(s)))).alias(f"q{i}")

    return at.select(*keys, "n", *(share(i, s) for i, s in enumerate(shares)))
