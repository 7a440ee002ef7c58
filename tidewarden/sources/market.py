"""The driver's tables read as market data.

events are ticks (instrument = event_type, feed = user_id mod 3, price = value); orders by day are a daily index;
nation and region are an instrument dimension. Times are epoch seconds, UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86_400
FEEDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Epoch seconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def day_text(seconds: Column | str) -> Column:
    """yyyy-mm-dd of epoch seconds."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / DAY).cast("int")).cast("string")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, asset, feed, t, price, size."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("asset"), (F.col("user_id") % FEEDS).alias("feed"), epoch("ts").alias("t"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each instrument."""
    from ..operators.bars import fold

    return fold(ticks(spark, sf_dir), ["asset"], HOUR)


def feed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each instrument and feed."""
    from ..operators.bars import fold

    return fold(ticks(spark, sf_dir), ["asset", "feed"], HOUR)


def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day (epoch seconds), close, available_at: mean order price of each order day, known the next day at 15:00."""
    o = table(spark, sf_dir, "orders").select(epoch("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return o.groupBy("day").agg((F.sum("p").cast("double") / F.count(F.lit(1))).alias("close")).withColumn("available_at", F.col("day") + DAY + 15 * HOUR)
