"""The instrument dimension: rows of a configuration, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def problems(config: DataFrame, templates: DataFrame, sources: list[str], least: int = 2) -> DataFrame:
    """config (ticker, source, block, template, tick) with problem: the first rule that a row breaks, or empty text.

    Sources come from a list; ticks are above zero; session templates are described in `templates` (template); a source lists a
    ticker once; a block has `least` members or more. Rows are counted by shuffles with map-side combining and joined back."""
    named = ["source", "ticker"]
    listed = config.groupBy(*named).agg(F.count(F.lit(1)).alias("_listed"))
    members = config.groupBy("block").agg(F.count(F.lit(1)).alias("_members"))
    c = (
        config.join(listed, named, "left").join(members, "block", "left")
        .join(templates.select("template", F.lit(True).alias("_told")).distinct(), "template", "left")
    )
    missing = F.lit(False)
    for n in ("ticker", "source", "block", "template", "tick"):
        missing = missing | F.col(n).isNull()
    problem = (
        F.when(missing, "a field is missing")
        .when(~F.col("source").isin(sources), "unknown source")
        .when(F.isnan("tick") | (F.col("tick") <= 0), "tick not above zero")
        .when(F.col("_listed") > 1, "listed twice")
        .when(F.col("_told").isNull(), "template not described")
        .when(F.col("_members") < least, "block too small")
        .otherwise("")
    )
    return c.withColumn("problem", problem).select(*config.columns, "problem")


def checked(config: DataFrame, templates: DataFrame, sources: list[str], least: int = 2) -> DataFrame:
    """config, which has to be without problems: reading a row that has one fails."""
    found = problems(config, templates, sources, least)
    bad = F.raise_error(F.concat_ws(": ", "ticker", "problem")).cast("string")
    return found.withColumn("ticker", F.when(F.col("problem") != "", bad).otherwise(F.col("ticker"))).drop("problem")


def largest_first(config: DataFrame) -> DataFrame:
    """config with place: the row's number in its block, by tick, largest first."""
    return config.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("tick"), "ticker")))
