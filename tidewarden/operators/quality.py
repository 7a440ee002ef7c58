"""Validation of bars, and membership of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import quantiles, trailing


def ohlc_inconsistent(tick: float) -> Column:
    """Open or close outside low to high by more than half a tick; a hair of slack keeps exactly half a tick in."""
    tolerance = F.lit(tick / 2 * (1 + 1e-9))
    return (F.col("low") > F.least("open", "close") + tolerance) | (F.greatest("open", "close") > F.col("high") + tolerance)


def thin(bars: DataFrame, volume: str, keys: list[str], span: int, least: int, share: float) -> DataFrame:
    """bars with thin: no volume, or less than `share` of the median of the nonzero volumes of the `span` bars before."""
    nz = bars.withColumn("_nz", F.when(F.col(volume) > 0, F.col(volume)))
    m = trailing(nz, keys, "hour", "_nz", span, lambda w: quantiles(w, (0.5,), least), "_median double")
    return m.withColumn("thin", (F.col(volume) <= 0) | F.coalesce(F.col(volume) < share * F.col("_median"), F.lit(False))).drop("_nz", "_median")


def invalid_reason(tick: float) -> Column:
    """The first rule that a bar breaks, or empty text."""
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    missing = prices[0].isNull() | prices[1].isNull() | prices[2].isNull() | prices[3].isNull()
    return (
        (
            F.when(missing, "removed").when(F.least(*prices) <= 0, "not above zero").when(ohlc_inconsistent(tick), "body outside range")
            .when(F.col("volume") < 0, "volume below zero").otherwise("")
        )
    )


def overlaps(bars: DataFrame, sessions: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """bars with in_session: whether [hour, hour + seconds) meets a session [open, close) of its keys.

    Sessions are dealt to the days they touch, so the range join is an equi-join on keys and day. Without keys, sessions hold for all bars."""
    days = (
        sessions.withColumn("day", F.explode(F.sequence(F.floor(F.col("open_at") / 86400), F.floor((F.col("close_at") - 1) / 86400))))
        .select(*keys, "day", "open_at", "close_at")
    )
    b = bars.withColumn("day", F.explode(F.array_distinct(F.array(F.floor(F.col("hour") / 86400), F.floor((F.col("hour") + seconds - 1) / 86400)))))
    hit = b.join(days, [*keys, "day"]).where((F.col("hour") < F.col("close_at")) & (F.col("hour") + seconds > F.col("open_at")))
    inside = hit.select(*keys, "hour").distinct().withColumn("in_session", F.lit(True))
    return bars.join(inside, [*keys, "hour"], "left").withColumn("in_session", F.coalesce("in_session", F.lit(False)))
