"""SQL of the relations that queries start from, and column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = r"""ticks AS (SELECT event_id, event_type AS asset, user_id % 3 AS feed, epoch_us(ts) // 1000000 AS t, value AS price,
  CAST(regexp_extract(props, '\d+') AS BIGINT) AS size FROM events)"""
_FOLD = "arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, sum(size)::DOUBLE AS volume, count(*) AS n_src"
BARS = f"{TICKS}, bars AS (SELECT asset, t // 3600 * 3600 AS hour, {_FOLD} FROM ticks GROUP BY 1, 2)"
FEED_BARS = f"{TICKS}, fbars AS (SELECT asset, feed, t // 3600 * 3600 AS hour, {_FOLD} FROM ticks GROUP BY 1, 2, 3)"
GOOD = "least(open, high, low, close) > 0"
#: Usable bars with r and hole; a session is a UTC day.
MOVES = f"""{BARS}, m AS (
  SELECT *, lag(close) OVER w AS pc, lag(hour) OVER w AS ph FROM bars WHERE {GOOD} WINDOW w AS (PARTITION BY asset ORDER BY hour)),
moves AS (SELECT asset, hour, open, high, low, close, volume, n_src, ph IS NULL OR hour // 86400 <> ph // 86400 AS is_open,
  CASE WHEN ph IS NULL THEN NULL WHEN hour // 86400 <> ph // 86400 OR hour - ph > 3600 THEN ln(close / open) ELSE ln(close / pc) END AS r,
  CASE WHEN ph IS NOT NULL AND hour // 86400 <> ph // 86400 THEN ln(open / pc) END AS gap,
  CASE WHEN hour // 86400 = ph // 86400 AND hour - ph > 3600 THEN ln(open / pc) END AS hole FROM m)"""
WEEK = 7 * 86_400
LEAST = 20
WORDS = (("notable", 1.5), ("large", 2.0), ("rare", 2.5), ("extreme", 3.0))
_WORD = "CASE WHEN abs(z) >= 3.0 THEN 'extreme' WHEN abs(z) >= 2.5 THEN 'rare' WHEN abs(z) >= 2.0 THEN 'large' WHEN abs(z) >= 1.5 THEN 'notable' END"
SCORED = f"""{MOVES}, prod AS (SELECT asset, hour, abs(r) * abs(lag(r) OVER (PARTITION BY asset ORDER BY hour)) AS x FROM moves WHERE r IS NOT NULL),
sg AS (SELECT asset, hour, CASE WHEN count(x) OVER w >= {LEAST} THEN sqrt(pi() / 2 * avg(x) OVER w) END AS sigma FROM prod
  WINDOW w AS (PARTITION BY asset ORDER BY hour RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING)),
zed AS (SELECT moves.*, sigma, CASE WHEN sigma > 0 THEN r / sigma END AS z, hour - min(CASE WHEN r IS NOT NULL THEN hour END) OVER (PARTITION BY
  asset) < {WEEK} AS young
  FROM moves LEFT JOIN sg USING (asset, hour)),
scored AS (SELECT *, {_WORD} AS word FROM zed)"""


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places, so that the order of a sum doesn't show."""
    return F.round(c, 6).alias(name or (c if isinstance(c, str) else "value"))


def usable(bars):
    return bars.where(F.least("open", "high", "low", "close") > 0)
