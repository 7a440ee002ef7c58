"""A store of rows by time: a folder a month, and a folder a year once the whole year is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import exists, names_in, remove, stage
from .bars import changed_partitions

#: Days after its end at which a year is settled, by the newest row.
DELAY = 7


def shard_of(at: Column, newest: Column, delay_days: int = DELAY) -> Column:
    """yyyy of a settled year's rows, else yyyy-mm."""
    start = F.lit("1970-01-01").cast("date")
    date = F.date_add(start, F.floor(at / 86_400).cast("int"))
    closes = (F.datediff(F.add_months(F.trunc(date, "year"), 12), start).cast("bigint") + delay_days) * 86_400
    return F.when(closes <= newest, F.substring(date.cast("string"), 1, 4)).otherwise(F.substring(date.cast("string"), 1, 7))


def write_shards(rows: DataFrame, path: str, at: str = "t", delay_days: int = DELAY) -> list[str]:
    """Bring the store in line with rows: shards whose rows differ are written again, and shards that no row belongs to any more are deleted
    (left without rows, or months whose year is settled now). Returns the names of the shards touched, in order.

    New shards are written before old ones go, and a year hides its months when it is read (`read_shards`): a run that ends in between leaves
    no row twice, and the next run cleans up."""
    spark = rows.sparkSession
    newest = rows.agg(F.max(at).alias("newest")).first()["newest"]
    named = rows.withColumn("shard", shard_of(F.col(at), F.lit(newest).cast("bigint"), delay_days))
    held = _held(spark, path, rows.schema)
    changed = stage(changed_partitions(held.select(*named.columns), named, "shard"), "changed")
    part = named.join(changed, "shard", "left_semi")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    live = {r[0] for r in named.select("shard").distinct().collect()}  # a name a month
    for name in names_in(spark, path):
        if name.startswith("shard=") and name.removeprefix("shard=") not in live:
            remove(spark, f"{path}/{name}")
    return sorted(r[0] for r in changed.collect())


def _held(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("shard", T.StringType())])
    return spark.read.schema(whole).parquet(path) if exists(spark, path) else spark.createDataFrame([], whole)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The store's rows with their shard; of a year that has a shard of its own, only that one's."""
    years = [n.removeprefix("shard=") for n in names_in(spark, path) if n.startswith("shard=") and "-" not in n]
    shard = F.col("shard")
    return _held(spark, path, schema).where((F.length(shard) == 4) | ~F.substring(shard, 1, 4).isin(years or ["none"]))
