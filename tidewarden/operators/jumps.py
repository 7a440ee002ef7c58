"""Moves, yardsticks and events: the jump detector as column expressions.

Windows are by the keys given. Over long histories, give rows and keys by blocks of time (`blocks.dealt`): a move looks back one row, a product two, a
yardstick as far as its window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, last_at_least
from .windows import range_mean

#: Words and their thresholds on |z|, the size beyond which a reading is a broken price, the way back
#: and length of a broken stretch, and the share of a size that counts as rare as it.
WORDS = (("notable", 4.0), ("large", 5.0), ("rare", 6.5), ("extreme", 9.0))
MISTAKE_SIGMA = 1000.0
STRETCH_BACK, STRETCH_BARS = 0.5, 24
RARE_SHARE = 0.95
HALF_PI = 1.5707963267948966


def word_of(z: Column, words=WORDS) -> Column:
    out = F.lit(None).cast("string")
    for name, level in words:
        out = F.when(F.abs(z) >= level, F.lit(name)).otherwise(out)
    return out


def channels(bars: DataFrame, keys: list[str], session: Column, hour: int = 3600) -> DataFrame:
    """r, gap, hole, is_open of each usable bar: the hour's own move, the move into a session, the move across missing hours.

    r is close to close, but open to close on a session's first bar and after a hole; a key's first bar has none."""
    w = Window.partitionBy(*keys).orderBy("hour")
    b = bars.withColumn("_s", session)
    b = b.withColumn("_pc", F.lag("close").over(w)).withColumn("_ph", F.lag("hour").over(w)).withColumn("_ps", F.lag("_s").over(w))
    first = F.col("_ph").isNull()
    is_open = first | (F.col("_s") != F.col("_ps"))
    hole = ~is_open & (F.col("hour") - F.col("_ph") > hour)
    own, whole, into = F.ln(F.col("close") / F.col("open")), F.ln(F.col("close") / F.col("_pc")), F.ln(F.col("open") / F.col("_pc"))
    return b.select(
        *bars.columns, is_open.alias("is_open"), F.when(first, F.lit(None)).when(is_open | hole, own).otherwise(whole).alias("r"),
        F.when(is_open & ~first, into).alias("gap"), F.when(hole, into).alias("hole"),
    )


def with_nights(moves: DataFrame, keys: list[str], night: str = "night") -> DataFrame:
    """Moves whose first hour the feeds saw happen overnight (`night`, their move; null elsewhere) moved into the night: the gap becomes the feeds'
    night, with what else the stored gap had taken out, and r the rest of the move from the close before. The sum stays the store's; a gap that is
    unscored stays so, as does a row without a move or a row before it."""
    total = F.ln(F.col("close") / F.lag("close").over(Window.partitionBy(*keys).orderBy("hour")))
    told = moves.withColumn("_total", F.when(F.col(night).isNotNull() & F.col("r").isNotNull(), total))
    moved = F.col("_total").isNotNull()
    gap = F.when(moved, F.col("gap") - (F.col("_total") - F.col("r")) + F.col(night)).otherwise(F.col("gap"))
    r = F.when(moved, F.col("_total") - F.col(night)).otherwise(F.col("r"))
    return told.withColumns({"gap": gap, "r": r}).drop("_total")


def sigma(rows: DataFrame, keys: list[str], r: str, seconds: int, least: int, out: str = "sigma", at: str = "hour") -> DataFrame:
    """rows with the bipower yardstick of the readings strictly before each within `seconds`.

    Products pair each valid reading with the valid one before it and are stamped at the later; a missing reading
    has no yardstick, and leaves no product."""
    w = Window.partitionBy(*keys, F.col(r).isNull()).orderBy(at)
    made = rows.withColumn("_x", F.when(F.col(r).isNotNull(), F.abs(r) * F.abs(F.lag(r).over(w))))
    mean = range_mean("_x", at, keys, seconds, least)
    return made.withColumn(out, F.when(F.col(r).isNotNull(), F.sqrt(F.lit(HALF_PI) * mean))).drop("_x")


def score(rows: DataFrame, keys: list[str], seconds: int, least: int, r: str = "r", at: str = "hour", words=WORDS) -> DataFrame:
    """rows with sigma, z, word, young (whether the window is still shorter than `seconds`)."""
    s = sigma(rows, keys, r, seconds, least, at=at)
    z = F.when(F.col("sigma") > 0, F.col(r) / F.col("sigma"))
    first = F.min(F.when(F.col(r).isNotNull(), F.col(at))).over(Window.partitionBy(*keys))
    return s.withColumn("z", z).withColumn("word", word_of(F.col("z"), words)).withColumn("young", F.col(at) - first < seconds)


def trusted(rows: DataFrame, keys: list[str], seconds: int, least: int, mistake: float = MISTAKE_SIGMA, cut=None) -> DataFrame:
    """rows with r cleared of impossible readings, and the yardstick without them: repeated until a pass finds none.

    Each pass takes out one reading at least, so this ends. Each is cut by `cut` (a staging function) so that the plan does not grow."""
    now = rows
    while True:
        s = sigma(now, keys, "r", seconds, least)
        wrong = F.coalesce(F.abs(F.col("r") / F.when(F.col("sigma") > 0, F.col("sigma"))) > mistake, F.lit(False))
        s = s.withColumn("_wrong", wrong)
        s = cut(s) if cut else s
        if s.where("_wrong").isEmpty():
            return s.drop("_wrong")
        now = s.withColumn("r", F.when(~F.col("_wrong"), F.col("r"))).drop("_wrong", "sigma")


def day_moves(rows: DataFrame, keys: list[str], day: str, moves: Column, extra: Column, seconds: int, least: int) -> DataFrame:
    """rows with day_r (the day's move so far) and sigma_day (bipower of whole days before)."""
    w = Window.partitionBy(*keys, day).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_m", moves).withColumn("_f", F.coalesce(F.col("_m"), F.lit(0.0)) + F.coalesce(extra, F.lit(0.0)))
    whole = r.groupBy(*keys, day).agg(F.sum("_f").alias("_move"), F.bool_or(F.col("_m").isNotNull()).alias("_scored"), F.max("hour").alias("_end"))
    yard = sigma(whole.where("_scored"), keys, "_move", seconds, least, out="sigma_day", at="_end").select(*keys, day, "sigma_day")
    return r.withColumn("day_r", F.sum("_f").over(w)).join(yard, [*keys, day], "left").drop("_m", "_f")


def rarest_since(scored: DataFrame, keys: list[str], bottom: float, share: float = RARE_SHARE, block: int = BLOCK) -> DataFrame:
    """Readings of |z| >= bottom with the last earlier reading of their keys and sign and at least `share` of their size."""
    known = scored.where(F.abs("z") >= share * bottom).withColumn("_sign", F.signum("z"))
    least = F.when(F.abs("z") >= bottom, F.abs("z") * share)
    out = last_at_least(known, [*keys, "_sign"], "hour", F.abs("z"), least, block).where(F.abs("z") >= bottom)
    return out.select(*scored.columns, F.col("since").alias("since_hour"), (F.col("since_value") * F.col("_sign")).alias("since_z"))
