"""Returns, yardsticks, scores, events: the detector over hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks, calendar, jumps, windows
from ..operators.bars import fold
from ..registry import query
from ..sources import market
from .common import BARS, GOOD, LEAST, MOVES, SCORED, TICKS, WEEK, WORDS, r6, usable

def day():
    """The UTC day of an hour."""
    return F.floor(F.col("hour") / market.DAY)


def moves(spark, sf):
    """Moves by blocks of time: each bar and the one before it."""
    return blocks.dealt(usable(market.bars(spark, sf)), ["asset"], "hour", 0, 1, lambda b, keys: jumps.channels(b, keys, day()))


def scored(spark, sf):
    """Moves, yardsticks and scores by blocks of time: a window, and two bars before it."""
    return blocks.dealt(
        usable(market.bars(spark, sf)), ["asset"], "hour", WEEK, 2,
        lambda b, keys: jumps.score(jumps.channels(b, keys, day()), keys, WEEK, LEAST, words=WORDS),
    )


@query("flagship_daily_top_moves", f"""WITH {SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY asset, hour // 86400 ORDER BY abs(z) DESC,
  hour) AS n FROM scored WHERE word IS NOT NULL)
SELECT asset, hour, round(r, 6) AS r, round(sigma, 6) AS sigma, round(z, 6) AS z, word, young FROM top WHERE n = 1""")
def flagship_daily_top_moves(spark, sf):
    """Ticks to bars to moves to yardsticks to words; the most unusual hour of each instrument and day."""
    w = Window.partitionBy("asset", day()).orderBy(F.abs("z").desc(), "hour")
    top = scored(spark, sf).where("word is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    return top.select("asset", "hour", r6("r"), r6("sigma"), r6("z"), "word", "young")


@query("E1_trailing_bipower", f"WITH {SCORED} SELECT asset, hour, round(sigma, 6) AS sigma FROM scored")
def e1(spark, sf):
    return scored(spark, sf).select("asset", "hour", r6("sigma"))


#: The same moves by minutes: bars of 60 seconds, holes of over a minute.
_MINUTES = MOVES.replace("t // 3600 * 3600", "t // 60 * 60").replace("hour - ph > 3600", "hour - ph > 60")


@query(
    "E1_minute_bipower",
    f"""WITH {_MINUTES}, p AS (SELECT asset, hour, r, abs(r) * abs(lag(r) OVER (PARTITION BY asset ORDER BY hour)) AS x FROM moves WHERE r IS NOT NULL),
s AS (SELECT asset, hour, CASE WHEN count(x) OVER w >= {LEAST} THEN sqrt(pi() / 2 * avg(x) OVER w) END AS sigma FROM p
  WINDOW w AS (PARTITION BY asset ORDER BY hour RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))
SELECT moves.asset, moves.hour, round(sigma, 6) AS sigma FROM moves LEFT JOIN s ON s.asset = moves.asset AND s.hour = moves.hour""",
)
def e1_minutes(spark, sf):
    """The yardstick of a day over bars of a minute: the detector's longest table."""
    bars = usable(fold(market.ticks(spark, sf), ["asset"], 60))
    yard = lambda b, keys: jumps.sigma(jumps.channels(b, keys, day(), hour=60), keys, "r", 86_400, LEAST)
    return blocks.dealt(bars, ["asset"], "hour", 86_400, 2, yard).select("asset", "hour", r6("sigma"))


def _passes(n: int) -> str:
    """SQL of n passes of the yardstick, each without the readings that the one before found impossible; passes after the last find give the same."""
    parts, of = [MOVES], "SELECT asset, hour, r FROM moves"
    for i in range(n):
        parts.append(f"""x{i} AS (SELECT asset, hour, r, abs(r) * abs(lag(r) OVER (PARTITION BY asset ORDER BY hour)) AS x FROM ({of}) WHERE r IS NOT
  NULL),
y{i} AS (SELECT asset, hour, r, CASE WHEN count(x) OVER w >= {LEAST} THEN sqrt(pi() / 2 * avg(x) OVER w) END AS s FROM x{i} WINDOW w AS (PARTITION BY
  asset ORDER BY hour RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING)),
z{i} AS MATERIALIZED (SELECT asset, hour, CASE WHEN s > 0 AND abs(r / s) > 6 THEN NULL ELSE r END AS r, s FROM y{i})""")
        of = f"SELECT asset, hour, r FROM z{i}"
    return "WITH " + ", ".join(parts) + f""" SELECT m.asset, m.hour, round(z.r, 6) AS r, round(z.s, 6) AS sigma FROM moves m LEFT JOIN z{n - 1} z ON
  z.asset = m.asset AND z.hour = m.hour"""


@query("E2_trusted_sigma", _passes(12))
def e2(spark, sf):
    """Fixpoint: readings beyond 6 yardsticks leave until none is left (a driver loop over staged passes)."""
    out = jumps.trusted(moves(spark, sf), ["asset"], WEEK, LEAST, mistake=6.0, cut=lambda d: staged(d))
    return out.select("asset", "hour", r6("r"), r6("sigma"))


def staged(df):
    """df written to the shared folder and read back."""
    from ..sources.staging import stage

    return stage(df, "pass")


@query("E3_broken_stretch", f"""WITH RECURSIVE {MOVES}, mv AS (SELECT asset, hour, r, row_number() OVER (PARTITION BY asset ORDER BY hour) AS i FROM
  moves WHERE r IS NOT NULL),
k AS (SELECT * FROM mv WHERE asset IN (SELECT asset FROM mv WHERE abs(r) >= 3)),
e(asset, i, hour, size, moved, n, inside) AS (
  SELECT DISTINCT asset, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, FALSE FROM k
  UNION ALL
  SELECT k.asset, k.i, k.hour, CASE WHEN e.n > 0 THEN e.size ELSE abs(k.r) END, CASE WHEN e.n > 0 THEN e.moved + k.r ELSE k.r END,
    CASE WHEN e.n > 0 THEN CASE WHEN abs(e.moved + k.r) <= 0.5 * e.size THEN 0 ELSE e.n - 1 END WHEN abs(k.r) >= 3 THEN 23 ELSE 0 END, e.n > 0
  FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1)
SELECT asset, hour, inside AS in_stretch FROM e WHERE i > 0""")
def e3(spark, sf):
    """Hours after a move of 3 or more (in log) until the price is half way back; instruments without one are left out."""
    m = moves(spark, sf).where("r is not null").select("asset", "hour", "r")
    hit = m.join(m.where("abs(r) >= 3").select("asset").distinct(), "asset", "left_semi")

    def step(state, r):
        """state: size of the break, move since, bars that may still be within."""
        size, moved, left = state
        if left:
            moved += r
            return (size, moved, 0 if abs(moved) <= jumps.STRETCH_BACK * size else left - 1), (True,)
        return (abs(r), r, jumps.STRETCH_BARS - 1 if abs(r) >= 3 else 0), (False,)

    return windows.folded(hit, ["asset"], "hour", ["r"], step, lambda: (0.0, 0.0, 0), "in_stretch boolean").select("asset", "hour", "in_stretch")


@query("E4_minimum_count", "WITH " + TICKS + """, b AS (SELECT asset, count(DISTINCT t // 3600) AS n_hours, count(DISTINCT t // 86400) AS n_days FROM
  ticks GROUP BY 1) SELECT asset, ceil(sqrt(252 * n_hours / n_days))::BIGINT AS min_count FROM b""")
def e4(spark, sf):
    t = (
        market.ticks(spark, sf).groupBy("asset")
        .agg(F.count_distinct(F.floor(F.col("t") / 3600)).alias("h"), F.count_distinct(F.floor(F.col("t") / 86400)).alias("d"))
    )
    return t.select("asset", F.ceil(F.sqrt(F.lit(252) * F.col("h") / F.col("d"))).cast("long").alias("min_count"))


@query("E5_score", f"WITH {SCORED} SELECT asset, hour, round(z, 6) AS z, young FROM scored")
def e5(spark, sf):
    return scored(spark, sf).select("asset", "hour", r6("z"), "young")


@query("E6_word_counts", f"WITH {SCORED} SELECT asset, word, count(*) AS n FROM scored WHERE word IS NOT NULL GROUP BY 1, 2")
def e6(spark, sf):
    return scored(spark, sf).where("word is not null").groupBy("asset", "word").agg(F.count(F.lit(1)).alias("n"))


@query("E7_gap_kinds", f"""WITH {MOVES}, g AS (SELECT asset, hour, gap, CASE WHEN hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour) >= 10800
  THEN 'long' ELSE 'night' END AS kind FROM moves),
h AS (SELECT * FROM g WHERE gap IS NOT NULL), p AS (SELECT *, abs(gap) * abs(lag(gap) OVER (PARTITION BY asset, kind ORDER BY hour)) AS x FROM h),
s AS (SELECT *, CASE WHEN count(x) OVER w >= 5 THEN sqrt(pi() / 2 * avg(x) OVER w) END AS sigma FROM p WINDOW w AS (PARTITION BY asset, kind ORDER BY
  hour RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING))
SELECT asset, kind, hour, round(gap, 6) AS gap, round(gap / CASE WHEN sigma > 0 THEN sigma END, 6) AS z FROM s""")
def e7(spark, sf):
    """Gaps scored against gaps of their kind."""
    return gaps(spark, sf).select("asset", "kind", "hour", r6("gap"), r6("z"))


def gaps(spark, sf):
    def kinds(b, keys):
        pause = F.col("hour") - F.lag("hour").over(Window.partitionBy(*keys).orderBy("hour"))
        return jumps.channels(b, keys, day()).withColumn("kind", F.when(pause >= 10800, "long").otherwise("night")).where("gap is not null")

    g = blocks.dealt(usable(market.bars(spark, sf)), ["asset"], "hour", 0, 1, kinds)
    return blocks.dealt(g, ["asset", "kind"], "hour", 30 * 86400, 1, lambda r, keys: jumps.score(r, keys, 30 * 86400, 5, r="gap"))


_DAYS = f"""{SCORED}, dm AS (SELECT *, hour // 86400 AS d, CASE WHEN r IS NOT NULL OR gap IS NOT NULL THEN coalesce(r, 0) + coalesce(gap, 0) END AS
  mv,
  coalesce(r, 0) + coalesce(gap, 0) + coalesce(hole, 0) AS f FROM scored),
sofar AS (SELECT *, sum(f) OVER (PARTITION BY asset, d ORDER BY hour ROWS UNBOUNDED PRECEDING) AS day_r FROM dm),
whole AS (SELECT asset, d, sum(f) AS mv, max(hour) AS e FROM dm GROUP BY 1, 2 HAVING bool_or(mv IS NOT NULL)),
wp AS (SELECT *, abs(mv) * abs(lag(mv) OVER (PARTITION BY asset ORDER BY e)) AS x FROM whole),
ws AS (SELECT asset, d, CASE WHEN count(x) OVER w >= 5 THEN sqrt(pi() / 2 * avg(x) OVER w) END AS sigma_day FROM wp WINDOW w AS (PARTITION BY asset
  ORDER BY e RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)),
days AS (SELECT sofar.*, sigma_day FROM sofar LEFT JOIN ws USING (asset, d))"""


def with_days(spark, sf):
    s = scored(spark, sf).withColumn("d", day())
    either = F.col("r").isNotNull() | F.col("gap").isNotNull()
    own = F.when(either, F.coalesce("r", F.lit(0.0)) + F.coalesce("gap", F.lit(0.0)))
    return jumps.day_moves(s, ["asset"], "d", own, F.col("hole"), 30 * 86400, 5)


@query("E8_day_moves", f"WITH {_DAYS} SELECT asset, hour, round(day_r, 6) AS day_r, round(sigma_day, 6) AS sigma_day FROM days")
def e8(spark, sf):
    return with_days(spark, sf).select("asset", "hour", r6("day_r"), r6("sigma_day"))


def day_ok(d, k=0.5):
    return d.withColumn("day_ok", F.col("sigma_day").isNull() | (F.abs("day_r") >= k * F.col("sigma_day")))


@query("E9_day_filter", f"""WITH {_DAYS} SELECT asset, hour, word, sigma_day IS NULL OR abs(day_r) >= 0.5 * sigma_day AS day_ok FROM days WHERE word
  IS NOT NULL""")
def e9(spark, sf):
    return day_ok(with_days(spark, sf)).where("word is not null").select("asset", "hour", "word", "day_ok")


@query("E10_channels", f"WITH {MOVES} SELECT asset, hour, is_open, round(r, 6) AS r, round(gap, 6) AS gap, round(hole, 6) AS hole FROM moves")
def e10(spark, sf):
    return moves(spark, sf).select("asset", "hour", "is_open", r6("r"), r6("gap"), r6("hole"))


@query("E11_session_ids", f"""WITH {BARS}, l AS (SELECT asset, hour, hour - CASE WHEN hour // 86400 BETWEEN 19792 AND 20029 THEN 14400 ELSE 18000 END
  AS local FROM bars)
SELECT asset, hour, strftime(make_timestamp(local * 1000000), '%Y-%m-%d') AS fund_day, strftime(make_timestamp((local + 25200) * 1000000), '%Y-%m-%d')
  AS fx_day,
  ((local + 25200 + 259200) // 604800)::BIGINT AS fx_week FROM l""")
def e11(spark, sf):
    """Trading days by template: a fund's day in New York, the currency day that turns at 17:00 there, its week."""
    b = market.bars(spark, sf).withColumn("local", calendar.local_seconds(F.col("hour"), "America/New_York"))
    turned = F.col("local") + 7 * 3600
    return b.select(
        "asset", "hour", market.day_text("local").alias("fund_day"), market.day_text(turned).alias("fx_day"),
        F.floor((turned + 259200) / 604800).alias("fx_week"),
    )


#: Sessions of the exchange template: weekdays, 14:00 to 21:00 UTC.
_IN = "hour % 86400 BETWEEN 50400 AND 72000 AND (hour // 86400 + 4) % 7 BETWEEN 1 AND 5"
_SESSION = f"""{BARS}, u AS (SELECT *, hour // 86400 AS d FROM bars WHERE {GOOD} AND {_IN}),
v AS (SELECT *, lag(close) OVER w AS pc, lag(hour) OVER w AS ph, lag(d) OVER w AS pd FROM u WINDOW w AS (PARTITION BY asset ORDER BY hour)),
acts AS (SELECT event_type AS asset, epoch_us(ts) // 86400000000 AS d, max(CASE WHEN event_id % 97 = 0 THEN 0.01 ELSE 0 END) AS step, bool_or(event_id
  % 501 = 0) AS rolled FROM events GROUP BY 1, 2)"""


def in_session(hour="hour"):
    h = F.col(hour)
    return (h % 86400).between(50400, 72000) & F.pmod(F.floor(h / 86400) + 4, F.lit(7)).between(1, 5)


def actions(spark, sf):
    """Payout steps and rolls by instrument and day, derived from the ticks' numbers."""
    t = market.ticks(spark, sf)
    return t.groupBy("asset", F.floor(F.col("t") / 86400).alias("d")).agg(
        F.max(F.when(F.col("event_id") % 97 == 0, 0.01).otherwise(0.0)).alias("step"), F.bool_or(F.col("event_id") % 501 == 0).alias("rolled"))


def with_previous(rows, names):
    """rows with columns of the instrument's row before (new name to name), by blocks of time."""
    def lagged(b, keys):
        w = Window.partitionBy(*keys).orderBy("hour")
        return b.withColumns({new: F.lag(n).over(w) for new, n in names.items()})

    return blocks.dealt(rows, ["asset"], "hour", 0, 1, lagged)


@query("E12_overnight_gaps", f"""WITH {_SESSION}, prev AS (SELECT *, CASE WHEN (d + 4) % 7 = 1 THEN d - 3 ELSE d - 1 END AS want FROM v),
g AS (SELECT prev.*, step, rolled, ln(open / pc) + ln(1 + coalesce(step, 0)) AS raw FROM prev LEFT JOIN acts USING (asset, d))
SELECT asset, hour, round(CASE WHEN pd = want AND ph % 86400 >= 68400 AND hour % 86400 <= 54000 AND NOT coalesce(rolled, FALSE)
  AND NOT (abs(raw - ln(2)) < 0.01 OR abs(raw - ln(3)) < 0.01 OR abs(raw - ln(4)) < 0.01 OR abs(raw + ln(2)) < 0.01) THEN raw END, 6) AS gap FROM g
  WHERE pd IS NULL OR pd <> d""")
def e12(spark, sf):
    """Night moves: only from the previous calendar session's last bars, at the open, with no roll; payouts added; split-like moves left out."""
    u = with_previous(usable(market.bars(spark, sf)).where(in_session()).withColumn("d", day()), {"pc": "close", "ph": "hour", "pd": "d"})
    u = u.where(F.col("pd").isNull() | (F.col("pd") != F.col("d"))).join(actions(spark, sf), ["asset", "d"], "left")
    raw = F.ln(F.col("open") / F.col("pc")) + F.log1p(F.coalesce("step", F.lit(0.0)))
    want = F.when(F.pmod(F.col("d") + 4, F.lit(7)) == 1, F.col("d") - 3).otherwise(F.col("d") - 1)
    split = F.exists(F.array(*(F.ln(F.lit(x)) for x in (2.0, 3.0, 4.0, 0.5))), lambda s: F.abs(raw - s) < 0.01)
    ok = (F.col("pd") == want) & (F.col("ph") % 86400 >= 68400) & (F.col("hour") % 86400 <= 54000) & ~F.coalesce("rolled", F.lit(False)) & ~split
    return u.select("asset", "hour", r6(F.when(ok, raw), "gap"))


@query("E13_closed_on_last_bar", f"""WITH {_SESSION} SELECT asset, hour, pd = CASE WHEN (d + 4) % 7 = 1 THEN d - 3 ELSE d - 1 END AND ph % 86400 =
  72000 AS closed FROM v WHERE pd IS NOT NULL AND pd <> d""")
def e13(spark, sf):
    u = with_previous(usable(market.bars(spark, sf)).where(in_session()).withColumn("d", day()), {"ph": "hour", "pd": "d"})
    want = F.when(F.pmod(F.col("d") + 4, F.lit(7)) == 1, F.col("d") - 3).otherwise(F.col("d") - 1)
    return u.where("pd is not null and pd <> d").select("asset", "hour", ((F.col("pd") == want) & (F.col("ph") % 86400 == 72000)).alias("closed"))


@query("E14_held_at_close", f"""WITH {SCORED}, path AS (SELECT *, sum(coalesce(r, 0) + coalesce(gap, 0) + coalesce(hole, 0)) OVER (PARTITION BY asset
  ORDER BY hour) AS p FROM scored),
q AS (SELECT *, ((hour + 3600 - 75600 + 86399) // 86400) * 86400 + 75600 AS c FROM path WHERE word IS NOT NULL),
att AS (SELECT q.*, path.p AS pc FROM q ASOF LEFT JOIN (SELECT asset, hour + 3600 AS e, p FROM path) path ON q.asset = path.asset AND q.c >= path.e)
SELECT asset, hour, CASE WHEN c <= (SELECT max(hour) + 3600 FROM bars) THEN round((pc - (p - r)) / r, 6) END AS held FROM att""")
def e14(spark, sf):
    """How much of a move is left at the next close (21:00 UTC), by the log path and an as-of lookup."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    path = blocks.running(scored(spark, sf), ["asset"], "hour", {"p": zero("r") + zero("gap") + zero("hole")}).withColumn("e", F.col("hour") + 3600)
    close = F.floor((F.col("hour") + 3600 - 75600 + 86399) / 86400) * 86400 + 75600
    q = path.where("word is not null").withColumn("c", close).select("asset", "hour", "r", "p", "c")
    newest = market.bars(spark, sf).agg((F.max("hour") + 3600).alias("newest"))
    out = windows.asof_backward(q, path.select("asset", "e", F.col("p").alias("pc")), ["asset"], "c", "e", ["pc"])
    held = F.when(F.col("c") <= F.col("newest"), (F.col("pc") - (F.col("p") - F.col("r"))) / F.col("r"))
    return out.crossJoin(F.broadcast(newest)).select("asset", "hour", r6(held, "held"))


_KINDS = f"""{SCORED}, gk AS (SELECT asset, hour, gap, CASE WHEN hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour) >= 10800 THEN 'long' ELSE
  'night' END AS kind FROM moves),
gx AS (SELECT *, abs(gap) * abs(lag(gap) OVER (PARTITION BY asset, kind ORDER BY hour)) AS x FROM gk WHERE gap IS NOT NULL),
gs AS (SELECT *, CASE WHEN count(x) OVER w >= 5 THEN sqrt(pi() / 2 * avg(x) OVER w) END AS s FROM gx WINDOW w AS (PARTITION BY asset, kind ORDER BY
  hour RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT asset, 'hour' AS kind, hour, z FROM scored UNION ALL SELECT asset, kind, hour, gap / CASE WHEN s > 0 THEN s END FROM gs)"""


def readings(spark, sf):
    """asset, kind, hour, z: hours, and gaps by their kind, each by its own yardstick."""
    hours = scored(spark, sf).select("asset", F.lit("hour").alias("kind"), "hour", "z")
    return hours.unionByName(gaps(spark, sf).select("asset", "kind", "hour", "z"))


@query("E15_rarest_since", f"""WITH {_KINDS}, k AS (SELECT * FROM kinds WHERE abs(z) >= 0.95 * 1.5)
SELECT a.asset, a.kind, a.hour, round(a.z, 6) AS z, max(b.hour) AS since_hour, round(arg_max(b.z, b.hour), 6) AS since_z FROM (SELECT * FROM k WHERE
  abs(z) >= 1.5) a
LEFT JOIN k b ON a.asset = b.asset AND a.kind = b.kind AND sign(a.z) = sign(b.z) AND b.hour < a.hour AND abs(b.z) >= 0.95 * abs(a.z) GROUP BY 1, 2, 3,
  4""")
def e15(spark, sf):
    """Hours are set against hours, nights against nights, long pauses against long pauses."""
    out = jumps.rarest_since(readings(spark, sf), ["asset", "kind"], 1.5)
    return out.select("asset", "kind", "hour", r6("z"), "since_hour", r6("since_z"))


@query("C11_theta_self_join", f"""WITH {SCORED}, k AS (SELECT asset, hour, z FROM scored WHERE abs(z) >= 2)
SELECT a.asset, a.hour, count(b.hour) AS n_as_large FROM k a LEFT JOIN k b ON a.asset = b.asset AND b.hour < a.hour AND abs(b.z) >= abs(a.z) GROUP BY
  1, 2""")
def c11(spark, sf):
    """How many earlier readings of the instrument were as large."""
    k = scored(spark, sf).where("abs(z) >= 2").select("asset", "hour", "z")
    return windows.earlier_at_least(k, ["asset"], "hour", F.abs("z"), F.abs("z"), []).select("asset", "hour", F.col("_n").alias("n_as_large"))


@query("E16_event_starts", f"""WITH RECURSIVE {SCORED}, k AS (SELECT asset, hour + 3600 AS found, row_number() OVER (PARTITION BY asset ORDER BY hour)
  AS i FROM scored WHERE word IS NOT NULL),
e AS (SELECT asset, found, i, found AS start FROM k WHERE i = 1 UNION ALL SELECT k.asset, k.found, k.i, CASE WHEN k.found < e.start + 86400 THEN
  e.start ELSE k.found END FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1)
SELECT asset, found, start AS event_start FROM e""")
def e16(spark, sf):
    """24 hours from the first reading of an event; later readings don't extend it."""
    k = scored(spark, sf).where("word is not null").select("asset", (F.col("hour") + 3600).alias("found"))
    return windows.event_starts(k, "asset", "found", 86400)


@query("E16_anchored_event_starts", f"""WITH RECURSIVE {SCORED}, f AS (SELECT asset, hour + 3600 AS found FROM scored WHERE word IS NOT NULL),
pins AS (SELECT DISTINCT asset, found // 864000 * 864000 + 43200 AS pin FROM f),
t AS (SELECT f.asset, f.found, min(CASE WHEN f.found >= pin AND f.found < pin + 86400 THEN pin END) AS held, min(CASE WHEN pin > f.found AND pin <=
  f.found + 86400 THEN pin END) AS ahead FROM f LEFT JOIN pins ON pins.asset = f.asset GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY found) AS i FROM t WHERE held IS NULL),
e(asset, i, found, current, start) AS (
  SELECT DISTINCT asset, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM k
  UNION ALL
  SELECT k.asset, k.i, k.found, CASE WHEN k.found < e.current + 86400 OR k.ahead IS NOT NULL THEN e.current ELSE k.found END,
    CASE WHEN k.found < e.current + 86400 THEN e.current WHEN k.ahead IS NOT NULL THEN k.ahead ELSE k.found END
  FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1)
SELECT asset, found, start AS event_start FROM e WHERE i > 0 UNION ALL SELECT asset, found, held FROM t WHERE held IS NOT NULL""")
def e16_anchored(spark, sf):
    """As E16 with pinned starts: here each instrument's every tenth day at noon."""
    k = scored(spark, sf).where("word is not null").select("asset", (F.col("hour") + 3600).alias("found"))
    pins = k.select("asset", (F.floor(F.col("found") / 864000) * 864000 + 43200).alias("anchor")).distinct()
    return windows.event_starts(k, "asset", "found", 86400, pins)


@query("E17_bars_upto", f"WITH {BARS} SELECT asset, hour, count(*) OVER (PARTITION BY asset ORDER BY hour) AS bars_upto FROM bars")
def e17(spark, sf):
    return blocks.running(market.bars(spark, sf), ["asset"], "hour", {"bars_upto": F.lit(1)}).select("asset", "hour", "bars_upto")


@query("D12_event_argmax", f"""WITH RECURSIVE {SCORED}, k AS (SELECT asset, hour, hour + 3600 AS found, z, word, row_number() OVER (PARTITION BY asset
  ORDER BY hour) AS i FROM scored WHERE word IS NOT NULL),
e AS (SELECT asset, i, found AS start FROM k WHERE i = 1 UNION ALL SELECT k.asset, k.i, CASE WHEN k.found < e.start + 86400 THEN e.start ELSE k.found
  END FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1),
j AS (SELECT k.*, start FROM k JOIN e USING (asset, i)), t AS (SELECT *, row_number() OVER (PARTITION BY asset, start ORDER BY abs(z) DESC, hour) AS
  n, count(*) OVER (PARTITION BY asset, start) AS n_rows FROM j)
SELECT asset, start AS event_start, hour, round(z, 6) AS z, word, n_rows FROM t WHERE n = 1""")
def d12(spark, sf):
    """The largest reading of each event."""
    k = scored(spark, sf).where("word is not null").select("asset", "hour", (F.col("hour") + 3600).alias("found"), "z", "word")
    e = windows.event_starts(k, "asset", "found", 86400)
    best = F.max_by(F.struct("hour", "z", "word"), F.struct(F.abs("z"), -F.col("hour"))).alias("b")
    return (
        e.groupBy("asset", "event_start").agg(best, F.count(F.lit(1)).alias("n_rows"))
        .select("asset", "event_start", "b.hour", r6(F.col("b.z"), "z"), "b.word", "n_rows")
    )


@query("B14_found_times", f"""WITH {SCORED} SELECT asset, hour, CASE WHEN is_open THEN hour ELSE hour + 3600 END AS found FROM scored WHERE word IS
  NOT NULL AND CASE WHEN is_open THEN hour ELSE hour + 3600 END <= 1706000000""")
def b14(spark, sf):
    found = F.when(F.col("is_open"), F.col("hour")).otherwise(F.col("hour") + 3600)
    return scored(spark, sf).where("word is not null").select("asset", "hour", found.alias("found")).where("found <= 1706000000")


@query("E25_with_votes", f"""WITH {MOVES}, doubt AS (SELECT DISTINCT asset, hour FROM bars WHERE n_src = 1 AND hour % 7 = 0)
SELECT asset, hour, round(CASE WHEN doubt.hour IS NULL THEN r END, 6) AS r FROM moves LEFT JOIN doubt USING (asset, hour)""")
def e25(spark, sf):
    """Moves that a vote found untrue are no readings."""
    doubt = market.bars(spark, sf).where("n_src = 1 and hour % 7 = 0").select("asset", "hour", F.lit(True).alias("doubt"))
    return moves(spark, sf).join(doubt, ["asset", "hour"], "left").select("asset", "hour", r6(F.when(F.col("doubt").isNull(), F.col("r")), "r"))


@query("N1_asset_metrics", f"""WITH {MOVES} SELECT asset, hour, close, volume, round(r, 6) AS r, is_open, round(hole, 6) AS hole, round(gap, 6) AS
  gap, (SELECT count(*) FROM bars b WHERE b.asset = moves.asset AND b.hour <= moves.hour) AS bars_upto FROM moves""")
def n1(spark, sf):
    """Gate, returns and stored-bar counts in one lineage."""
    b = blocks.running(market.bars(spark, sf), ["asset"], "hour", {"bars_upto": F.lit(1)})
    m = blocks.dealt(usable(b), ["asset"], "hour", 0, 1, lambda x, keys: jumps.channels(x, keys, day()))
    return m.select("asset", "hour", "close", "volume", r6("r"), "is_open", r6("hole"), r6("gap"), "bars_upto")


@query("N2_extend_equals_full", f"""WITH {MOVES}, n AS (SELECT asset, count(*) AS n FROM moves GROUP BY 1) SELECT asset, n, 0::BIGINT AS n_different
  FROM n""")
def n2(spark, sf):
    """Incremental maintenance: the last 48 rows recomputed with 200 rows before them, set against the full computation."""
    b = usable(market.bars(spark, sf))
    full = jumps.channels(b, ["asset"], day()).select("asset", "hour", "r", "gap", "hole")
    tail = jumps.channels(windows.last_rows(b, ["asset"], "hour", 248), ["asset"], day())
    tail = windows.last_rows(tail, ["asset"], "hour", 48).select("asset", "hour", F.struct("r", "gap", "hole").alias("new"))
    near = lambda a, b: F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-12 + 1e-9 * F.abs(b))
    both = full.join(tail, ["asset", "hour"], "left")
    same = F.col("new").isNull() | (near(F.col("new.r"), F.col("r")) & near(F.col("new.gap"), F.col("gap")) & near(F.col("new.hole"), F.col("hole")))
    return both.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("n_different"))


@query("N8_failed_assets_keep_rows", f"""WITH {SCORED} SELECT asset, count(*) AS n, count(*) FILTER (asset = 'error') AS n_previous FROM scored WHERE
  word IS NOT NULL GROUP BY 1""")
def n8(spark, sf):
    """A rescoring in which one instrument fails keeps that one's previous rows."""
    s = scored(spark, sf).where("word is not null").select("asset", "hour", "z", "word")
    previous, now = s.withColumn("kept", F.lit(1)), s.where("asset <> 'error'").withColumn("kept", F.lit(0))
    out = now.unionByName(previous.join(now.select("asset").distinct(), "asset", "left_anti"))
    return out.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("kept").alias("n_previous"))


@query("K1_reading_ids", f"""WITH {SCORED} SELECT concat_ws(':', asset, CASE WHEN is_open THEN 'open' ELSE 'hour' END, hour::VARCHAR) AS reading_id,
  word IN ('rare', 'extreme') AS pushed FROM scored WHERE word IS NOT NULL""")
def k1(spark, sf):
    kind = F.when(F.col("is_open"), "open").otherwise("hour")
    return (
        scored(spark, sf).where("word is not null")
        .select(
            F.concat_ws(":", "asset", kind, F.col("hour").cast("string")).alias("reading_id"), F.col("word").isin("rare", "extreme").alias("pushed"),
        )
    )


@query("D2_minimum_trades", f"""WITH {TICKS} SELECT asset, t // 1800 * 1800 AS hour, arg_min(price, event_id) AS open, arg_max(price, event_id) AS
  close, count(*) AS n_src FROM ticks GROUP BY 1, 2 HAVING count(*) >= 3""")
def d2(spark, sf):
    return fold(market.ticks(spark, sf), ["asset"], 1800, least=3).select("asset", "hour", "open", "close", "n_src")


@query("D1_to_hourly", f"WITH {BARS} SELECT asset, hour, open, high, low, close, volume, n_src FROM bars")
def d1(spark, sf):
    """Ticks to hourly bars."""
    return market.bars(spark, sf)


@query("H2_tail_recompute", f"WITH {MOVES} SELECT asset, hour, round(r, 6) AS r, round(gap, 6) AS gap, round(hole, 6) AS hole FROM moves")
def h2(spark, sf):
    """The last 48 rows of each instrument are computed anew with 1,000 rows before them; older rows stay as they were."""
    b = usable(market.bars(spark, sf))
    stored = jumps.channels(b, ["asset"], day()).select("asset", "hour", "r", "gap", "hole")
    fresh = (
        windows.last_rows(jumps.channels(windows.last_rows(b, ["asset"], "hour", 1048), ["asset"], day()), ["asset"], "hour", 48)
        .select(*stored.columns)
    )
    out = stored.join(fresh.select("asset", "hour"), ["asset", "hour"], "left_anti").unionByName(fresh)
    return out.select("asset", "hour", r6("r"), r6("gap"), r6("hole"))


@query("H8_recount_drops_healed", f"""WITH {MOVES}, was AS (SELECT asset, hour FROM moves WHERE abs(r) >= 2), now AS (SELECT asset, hour FROM moves
  WHERE abs(r) >= 2 AND hour // 3600 % 11 <> 0) SELECT w.asset, w.hour, n.hour IS NULL AS dropped FROM was w LEFT JOIN now n ON w.asset = n.asset AND
  w.hour = n.hour""")
def h8(spark, sf):
    """Votes on moves that a revision healed (here hours divisible by 11) are dropped; the others are counted again."""
    was = moves(spark, sf).where("abs(r) >= 2").select("asset", "hour")
    now = was.where(F.floor(F.col("hour") / 3600) % 11 != 0).withColumn("still", F.lit(True))
    return was.join(now, ["asset", "hour"], "left").select("asset", "hour", F.col("still").isNull().alias("dropped"))
