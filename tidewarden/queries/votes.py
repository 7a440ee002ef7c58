"""Votes between feeds, their tallies and their records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks, calendar, jumps, vote
from ..registry import SQL, query
from ..sources import market
from ..sources.staging import stage
from .common import FEED_BARS, GOOD, LEAST, MOVES, WEEK, r6, usable
from .scans import SESSIONS, all_days

FOLD = "arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close"
CAND = f"""{FEED_BARS}, bars AS (SELECT asset, t // 3600 * 3600 AS hour, {FOLD} FROM ticks GROUP BY 1, 2),
cb AS (SELECT asset, hour, close, lag(hour) OVER w AS prev_hour, lag(close) OVER w AS prev_close FROM bars WHERE least(open, high, low, close) > 0
  WINDOW w AS (PARTITION BY asset ORDER BY hour)),
cand AS (SELECT *, ln(close / prev_close) AS move FROM cb WHERE abs(ln(close / prev_close)) >= 1)"""
JUDGED = f"""{CAND}, gf AS (SELECT * FROM fbars WHERE open > 0 AND close > 0),
jj AS (SELECT cand.asset, cand.hour, f.feed, move, ln(e.close / b.close) AS own FROM cand CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS feed) f
  LEFT JOIN gf e ON e.asset = cand.asset AND e.feed = f.feed AND e.hour = cand.hour LEFT JOIN gf b ON b.asset = cand.asset AND b.feed = f.feed AND
  b.hour = cand.prev_hour),
judged AS (SELECT *, CASE WHEN own IS NULL THEN 'unknown' WHEN sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move) THEN 'confirmed' ELSE
  'unconfirmed' END AS answer FROM jj)"""
TALLY = f"""{JUDGED}, g AS (SELECT asset, hour, count(*) FILTER (answer = 'confirmed') AS c, count(*) FILTER (answer = 'unconfirmed') AS u,
  string_agg(feed::VARCHAR, ',' ORDER BY feed) AS feeds,
  coalesce(string_agg(feed::VARCHAR, ',' ORDER BY feed) FILTER (answer = 'confirmed'), '') AS seen FROM judged GROUP BY 1, 2),
tally AS (SELECT asset, hour, CASE WHEN c + u = 0 THEN 'uncertain' WHEN c + 1 > u THEN 'real' WHEN c + 1 = u THEN 'uncertain' ELSE 'not real' END AS
  verdict, c + 1 AS n_yes, u AS n_no, feeds, seen FROM g)"""


def judged(spark, sf):
    names = spark.range(market.FEEDS).select(F.col("id").alias("feed"))
    return vote.judge(vote.candidates(market.bars(spark, sf), 1.0), market.feed_bars(spark, sf), names)


def tally(spark, sf):
    return vote.tally(judged(spark, sf))


@query("I1_candidates", f"WITH {CAND} SELECT asset, hour, prev_hour, close AS price, prev_close, round(move, 6) AS move FROM cand")
def i1(spark, sf):
    return vote.candidates(market.bars(spark, sf), 1.0).select("asset", "hour", "prev_hour", "price", "prev_close", r6("move"))


_FAR = 2.0


def _yard(of: str, name: str) -> str:
    """SQL of the yardstick of the readings `of` (asset, kind, hour, r), at every hour of all readings."""
    return f"""{name}p AS (SELECT asset, kind, hour, abs(r) * abs(lag(r) OVER (PARTITION BY asset, kind ORDER BY hour)) AS x FROM {of}),
{name} AS (SELECT a.asset, a.kind, a.hour, CASE WHEN count(x) >= {LEAST} AND avg(x) > 0 THEN sqrt(pi() / 2 * avg(x)) END AS s FROM readings a LEFT JOIN {name}p p
  ON p.asset = a.asset AND p.kind = a.kind AND p.hour >= a.hour - {WEEK} AND p.hour < a.hour GROUP BY 1, 2, 3)"""


#: By brute force: each yardstick from pairs of readings, each doubt's own from a sequence without the other doubts.
_FAR_SQL = f"""WITH {MOVES}, hourly AS (SELECT asset, hour, close, lag(hour) OVER w AS prev_hour, lag(close) OVER w AS prev_close FROM bars WHERE {GOOD}
  WINDOW w AS (PARTITION BY asset ORDER BY hour)),
fb AS (SELECT asset, feed, t // 3600 * 3600 AS hour, arg_min(price, event_id) AS open, arg_max(price, event_id) AS close FROM ticks GROUP BY 1, 2, 3),
cand AS (SELECT *, ln(close / prev_close) AS move FROM hourly WHERE abs(ln(close / prev_close)) >= 1),
own AS (SELECT c.asset, c.hour, move, ln(e.close / b.close) AS own FROM cand c JOIN fb e ON e.asset = c.asset AND e.hour = c.hour JOIN fb b ON b.asset = c.asset AND
  b.feed = e.feed AND b.hour = c.prev_hour WHERE e.open > 0 AND e.close > 0 AND b.open > 0 AND b.close > 0),
untrue AS (SELECT asset, hour FROM own GROUP BY 1, 2 HAVING count(*) FILTER (NOT (sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move))) >
  count(*) FILTER (sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move)) + 1),
readings AS (SELECT m.asset, kind, m.hour, x AS r, u.hour IS NOT NULL AS doubt FROM (SELECT asset, hour, 'hour' AS kind, r AS x FROM moves UNION ALL SELECT
  asset, hour, 'gap', gap FROM moves) m LEFT JOIN untrue u ON u.asset = m.asset AND u.hour = m.hour WHERE x IS NOT NULL),
trusted AS (SELECT * FROM readings WHERE NOT doubt),
{_yard('readings', 'raw')}, {_yard('trusted', 'cor')},
alone AS (SELECT d.asset, d.kind, d.hour AS of, r.hour, r.r FROM readings d JOIN readings r ON r.asset = d.asset AND r.kind = d.kind AND (NOT r.doubt OR r.hour =
  d.hour) WHERE d.doubt),
alonep AS (SELECT asset, kind, of, hour, abs(r) * abs(lag(r) OVER (PARTITION BY asset, kind, of ORDER BY hour)) AS x FROM alone),
loo AS (SELECT asset, kind, of AS hour, CASE WHEN count(x) >= {LEAST} AND avg(x) > 0 THEN sqrt(pi() / 2 * avg(x)) END AS s FROM alonep WHERE hour >= of - {WEEK} AND
  hour < of GROUP BY 1, 2, 3),
z AS (SELECT r.asset, r.kind, r.hour, r.doubt, r.r / raw.s AS z_raw, r.r / CASE WHEN r.doubt THEN loo.s ELSE cor.s END AS z_corrected FROM readings r
  JOIN raw USING (asset, kind, hour) JOIN cor USING (asset, kind, hour) LEFT JOIN loo USING (asset, kind, hour))
SELECT asset, kind, hour, doubt, round(z_raw, 6) AS z_raw, round(z_corrected, 6) AS z_corrected FROM z WHERE abs(z_raw) >= {_FAR} OR abs(z_corrected) >= {_FAR}"""


@query("I1_yardstick_candidates", _FAR_SQL)
def i1_yardsticks(spark, sf):
    """Hours and gaps that are far by the yardstick of all readings, by the one without moves voted untrue, or, if voted so themselves, without the others."""
    bars = usable(market.bars(spark, sf))
    doubts = stage(tally(spark, sf).where("verdict = 'not real'").select("asset", "hour", F.lit(True).alias("doubt")), "doubts")

    def kinds(b, keys):
        m = jumps.channels(b, keys, F.floor(F.col("hour") / market.DAY))
        return m.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("x")) for k, c in (("hour", "r"), ("gap", "gap"))))).alias("_k"))

    m = blocks.dealt(bars, ["asset"], "hour", 0, 1, kinds).select("asset", "hour", "_k.kind", "_k.x").where("x is not null")
    m = m.join(doubts, ["asset", "hour"], "left").withColumn("doubt", F.coalesce("doubt", F.lit(False)))
    out = vote.far_readings(m, ["asset", "kind"], "x", WEEK, LEAST, _FAR).where("candidate")
    return out.select("asset", "kind", "hour", "doubt", r6("z_raw"), r6("z_corrected"))


#: How long the nearest source serves an hour, and how late one tick in eleven comes.
_REACH, _LATE = 10 * market.DAY, 3 * market.DAY


@query("H8_recounts", f"""WITH {CAND}, span AS (SELECT min(hour) // 86400 AS a, max(hour) // 86400 + 11 AS b FROM cand), {SESSIONS},
tk AS (SELECT *, t // 3600 * 3600 AS of, t + CASE WHEN event_id % 11 = 0 THEN {_LATE} * (1 + event_id % 2) ELSE 0 END AS delivered FROM ticks WHERE price > 0),
takes AS (SELECT asset, hour, prev_hour, move, 0 AS nth, hour + 3600 AS "at" FROM cand UNION ALL SELECT asset, hour, prev_hour, move, row_number() OVER (PARTITION BY asset,
  hour ORDER BY close_at), close_at FROM cand JOIN sessions ON close_at > hour + 3600 AND close_at <= hour + {_REACH}),
e1 AS (SELECT k.asset, k.hour, nth, feed, arg_max(price, event_id) AS c FROM takes k JOIN tk ON tk.asset = k.asset AND of = k.hour AND delivered <= k."at" GROUP BY 1, 2, 3, 4),
e0 AS (SELECT k.asset, k.hour, nth, feed, arg_max(price, event_id) AS c FROM takes k JOIN tk ON tk.asset = k.asset AND of = k.prev_hour AND delivered <= k."at" GROUP BY 1, 2, 3,
  4),
o AS (SELECT k.*, ln(e1.c / e0.c) AS own FROM takes k JOIN e1 USING (asset, hour, nth) JOIN e0 USING (asset, hour, nth, feed)),
n AS (SELECT asset, hour, nth, count(*) FILTER (sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move)) AS c, count(*) AS all_ FROM o GROUP BY 1, 2, 3),
v AS (SELECT asset, hour, nth, "at", coalesce(c, 0) + 1 AS n_yes, coalesce(all_ - c, 0) AS n_no FROM takes LEFT JOIN n USING (asset, hour, nth)),
w AS (SELECT *, CASE WHEN n_yes + n_no = 1 THEN 'uncertain' WHEN n_yes > n_no THEN 'real' WHEN n_yes = n_no THEN 'uncertain' ELSE 'not real' END AS verdict FROM v)
SELECT asset, hour, nth::BIGINT AS nth, "at", verdict, n_yes, n_no, coalesce(verdict <> lag(verdict) OVER (PARTITION BY asset, hour ORDER BY nth), FALSE) AS changed FROM w""")
def h8_recounts(spark, sf):
    """Every taking of every vote: when its move is found, then after each session until the nearest source no longer serves it, by what had come by then."""
    late = F.when(F.col("event_id") % 11 == 0, _LATE * (1 + F.col("event_id") % 2)).otherwise(0)
    ticks = market.ticks(spark, sf).withColumn("delivered", F.col("t") + late)
    found = vote.candidates(market.bars(spark, sf), 1.0).withColumn("found", F.col("hour") + 3600).select("asset", "hour", "prev_hour", "move", "found")
    days = all_days(found.select(F.floor(F.col("hour") / market.DAY).alias("d")), "d", 11)
    takes = stage(vote.retakes(found, calendar.exchange_sessions(days), _REACH), "takes")
    return vote.recounts(takes, ticks).select("asset", "hour", "nth", "at", "verdict", "n_yes", "n_no", "changed")


@query("I2_judge", f"WITH {JUDGED} SELECT asset, hour, feed, answer, round(own, 6) AS own_move FROM judged")
def i2(spark, sf):
    return judged(spark, sf).select("asset", "hour", "feed", "answer", r6("own_move"))


@query("I3_tally", f"WITH {TALLY} SELECT * FROM tally")
def i3(spark, sf):
    return tally(spark, sf)


@query("D13_verdict_counts", f"WITH {TALLY} SELECT asset, verdict, count(*) AS n FROM tally GROUP BY 1, 2")
def d13(spark, sf):
    return tally(spark, sf).groupBy("asset", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("C12_every_source_asked", f"WITH {JUDGED} SELECT feed, answer, count(*) AS n FROM judged GROUP BY 1, 2")
def c12(spark, sf):
    """Candidates times feeds, with an outage as an answer of its own."""
    return judged(spark, sf).groupBy("feed", "answer").agg(F.count(F.lit(1)).alias("n"))


@query("I4_overnight_move", f"""WITH {JUDGED}, o AS (SELECT asset, hour, feed, own FROM judged WHERE own IS NOT NULL AND hour % 86400 < 14400)
SELECT asset, hour, round(median(own), 6) AS night, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) >= 2""")
def i4(spark, sf):
    """The feeds' median move over the night's first hours, where two of them show it."""
    o = judged(spark, sf).where("own_move is not null and hour % 86400 < 14400")
    return o.groupBy("asset", "hour").agg(r6(F.percentile("own_move", 0.5), "night"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("D14_feed_nights", f"""WITH {JUDGED} SELECT asset, hour // 86400 AS d, round(median(own), 6) AS night FROM judged WHERE own IS NOT NULL GROUP
  BY 1, 2""")
def d14(spark, sf):
    o = judged(spark, sf).where("own_move is not null")
    return o.groupBy("asset", F.floor(F.col("hour") / 86400).alias("d")).agg(r6(F.percentile("own_move", 0.5), "night"))


_SW = f"""{FEED_BARS}, bars AS (SELECT asset, t // 3600 * 3600 AS hour, {FOLD} FROM ticks GROUP BY 1, 2),
j AS (SELECT b.asset, f.feed, b.hour // 86400 AS d, b.hour, ln(f.close / b.close) AS off FROM bars b JOIN fbars f ON b.asset = f.asset AND b.hour =
  f.hour WHERE b.close > 0 AND f.close > 0),
by_d AS (SELECT asset, feed, d, median(off) AS off, min(hour) AS first, count(*) AS n FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 3),
st AS (SELECT *, abs(off - lag(off) OVER (PARTITION BY asset, feed ORDER BY d)) * 1e4 AS step FROM by_d), sw AS (SELECT asset, feed, first, step FROM
  st WHERE step >= 50)"""


def switches(spark, sf):
    store = market.bars(spark, sf).withColumn("d", F.floor(F.col("hour") / 86400))
    return vote.switches(store, market.feed_bars(spark, sf), "d")


@query("D15_switches", f"WITH {_SW} SELECT asset, feed, first AS first_hour, round(step, 4) AS step_bp FROM sw")
def d15(spark, sf):
    return switches(spark, sf).select("asset", "feed", F.col("first").alias("first_hour"), F.round("step", 4).alias("step_bp"))


@query("I5_crosses", f"""WITH {_SW}, cb AS (SELECT asset, hour, close, lag(hour) OVER w AS prev_hour, lag(close) OVER w AS prev_close FROM bars WHERE
  least(open, high, low, close) > 0 WINDOW w AS (PARTITION BY asset ORDER BY hour)),
cand AS (SELECT * FROM cb WHERE abs(ln(close / prev_close)) >= 1) SELECT cand.asset, cand.hour, count(DISTINCT sw.feed) AS n_switching FROM cand LEFT
  JOIN sw ON sw.asset = cand.asset AND sw.first > cand.prev_hour AND sw.first <= cand.hour GROUP BY 1, 2""")
def i5(spark, sf):
    """Feeds that changed contract inside a move: a range join on the instrument and the days the move touches."""
    c = vote.candidates(market.bars(spark, sf), 1.0).select("asset", "hour", "prev_hour")
    asked = c.crossJoin(F.broadcast(spark.range(market.FEEDS).select(F.col("id").alias("feed"))))  # a handful of feeds
    hit = vote.crosses(asked, switches(spark, sf)).groupBy("asset", "hour").agg(F.count(F.lit(1)).alias("n"))
    return c.join(hit, ["asset", "hour"], "left").select("asset", "hour", F.coalesce("n", F.lit(0).cast("long")).alias("n_switching"))


def skipped(spark):
    """Hours of the day about which each feed is not asked."""
    return spark.createDataFrame([(0, [3, 4]), (1, [5]), (2, [])], "feed long, skip array<int>")


@query("I6_judge_found", f"""WITH {_SW}, cb AS (SELECT asset, hour, close, lag(hour) OVER w AS prev_hour, lag(close) OVER w AS prev_close FROM bars
  WHERE least(open, high, low, close) > 0 WINDOW w AS (PARTITION BY asset ORDER BY hour)),
cand AS (SELECT *, ln(close / prev_close) AS move FROM cb WHERE abs(ln(close / prev_close)) >= 1),
ask AS (SELECT cand.*, feed FROM cand CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS feed) WHERE NOT (feed = 0 AND hour // 3600 % 24 IN (3, 4)) AND
  NOT (feed = 1 AND hour // 3600 % 24 = 5)),
gf AS (SELECT * FROM fbars WHERE open > 0 AND close > 0),
jj AS (SELECT a.asset, a.hour, a.feed, a.move, CASE WHEN NOT EXISTS (SELECT 1 FROM sw WHERE sw.asset = a.asset AND sw.feed = a.feed AND sw.first >
  a.prev_hour AND sw.first <= a.hour) THEN ln(e.close / b.close) END AS own FROM ask a
  LEFT JOIN gf e ON e.asset = a.asset AND e.feed = a.feed AND e.hour = a.hour LEFT JOIN gf b ON b.asset = a.asset AND b.feed = a.feed AND b.hour =
  a.prev_hour),
g AS (SELECT asset, hour, count(*) FILTER (sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move)) AS c, count(own) AS answered, median(own) AS night
  FROM jj GROUP BY 1, 2)
SELECT asset, hour, CASE WHEN answered = 0 THEN 'uncertain' WHEN 2 * c + 1 > answered THEN 'real' WHEN 2 * c + 1 = answered THEN 'uncertain' WHEN hour
  % 86400 < 14400 AND answered >= 2 THEN 'overnight' ELSE 'not real' END AS verdict,
  CASE WHEN answered >= 2 AND 2 * c + 1 < answered AND hour % 86400 < 14400 THEN round(night, 6) END AS night, answered AS n_answered FROM g""")
def i6(spark, sf):
    """Candidates judged as a pass does: feeds that skip the hour are not asked, feeds across their own change of contract are out, and a night's move that
    is not real gives way to the feeds' median."""
    names = spark.range(market.FEEDS).select(F.col("id").alias("feed"))
    found = vote.candidates(market.bars(spark, sf), 1.0)
    j = vote.judge(found, market.feed_bars(spark, sf), names, skipped(spark), switches(spark, sf))
    answered = j.groupBy("asset", "hour").agg(F.count("own_move").alias("n_answered"))
    t = vote.tally(j).join(answered, ["asset", "hour"]).join(vote.overnight(j), ["asset", "hour"], "left")
    over = (F.col("verdict") == "not real") & (F.col("hour") % 86400 < 14400) & F.col("night").isNotNull()
    return t.select(
        "asset", "hour", F.when(over, "overnight").otherwise(F.col("verdict")).alias("verdict"), r6(F.when(over, F.col("night")), "night"),
        "n_answered",
    )


def _rounds(n: int) -> str:
    """SQL of n rounds of votes: bars less those voted down, candidates, answers, tally."""
    parts = [f"""{FEED_BARS}, b0 AS (SELECT asset, t // 3600 * 3600 AS hour, {FOLD} FROM ticks GROUP BY 1, 2), gf AS (SELECT * FROM fbars WHERE open >
  0 AND close > 0)"""]
    for i in range(n):
        parts.append(f"""c{i} AS (SELECT * FROM (SELECT asset, hour, lag(hour) OVER w AS p, ln(close / lag(close) OVER w) AS move FROM b{i} WHERE
  least(open, high, low, close) > 0 WINDOW w AS (PARTITION BY asset ORDER BY hour)) WHERE abs(move) >= 1),
a{i} AS (SELECT c.asset, c.hour, c.move, ln(e.close / s.close) AS own FROM c{i} c JOIN gf e ON e.asset = c.asset AND e.hour = c.hour JOIN gf s ON
  s.asset = c.asset AND s.feed = e.feed AND s.hour = c.p),
v{i} AS MATERIALIZED (SELECT asset, hour, {i} AS round FROM a{i} GROUP BY 1, 2 HAVING 1 + count(*) FILTER (sign(own) = sign(move) AND abs(own) >= 0.5
  * abs(move)) < count(*) FILTER (NOT (sign(own) = sign(move) AND abs(own) >= 0.5 * abs(move)))),
b{i + 1} AS MATERIALIZED (SELECT * FROM b{i} ANTI JOIN v{i} USING (asset, hour))""")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT asset, hour, round FROM v{i}" for i in range(n))


@query("E25_with_nights", f"""WITH {MOVES}, nights AS (SELECT asset, hour, night FROM ({SQL['I6_judge_found']}) WHERE verdict = 'overnight'),
p AS (SELECT moves.*, ln(close / lag(close) OVER (PARTITION BY moves.asset ORDER BY moves.hour)) AS total, night FROM moves LEFT JOIN nights USING (asset, hour)),
q AS (SELECT *, night IS NOT NULL AND r IS NOT NULL AND total IS NOT NULL AS moved FROM p)
SELECT asset, hour, moved, round(CASE WHEN moved THEN total - night ELSE r END, 6) AS r, round(CASE WHEN moved THEN gap - (total - r) + night ELSE gap END, 6) AS gap
FROM q""")
def e25_nights(spark, sf):
    """First hours that the feeds saw happen overnight, moved into their nights by the feeds' median; the nights' sizes are rounded as reported."""
    nights = stage(i6(spark, sf).where("verdict = 'overnight'").select("asset", "hour", "night"), "nights")

    bars = usable(market.bars(spark, sf)).join(nights, ["asset", "hour"], "left")
    m = blocks.dealt(bars, ["asset"], "hour", 0, 1, lambda b, keys: jumps.channels(b, keys, F.floor(F.col("hour") / market.DAY)))
    out = blocks.dealt(m, ["asset"], "hour", 0, 1, jumps.with_nights)
    return out.select("asset", "hour", (F.col("night").isNotNull() & F.col("r").isNotNull()).alias("moved"), r6("r"), r6("gap"))


@query("I7_vote_fixpoint", _rounds(4))
def i7(spark, sf):
    """Moves voted down leave the store and the rest is judged again, four rounds at most (a driver loop over staged bars)."""
    from ..sources.staging import stage

    bars, names, gone = stage(market.bars(spark, sf), "bars"), spark.range(market.FEEDS).select(F.col("id").alias("feed")), None
    for n in range(4):
        out = stage(
            vote.tally(vote.judge(
                vote.candidates(bars, 1.0), market.feed_bars(spark, sf), names,
            )).where("verdict = 'not real'").select("asset", "hour", F.lit(n).alias("round")),
            "voted",
        )
        if out.isEmpty():
            break
        gone = out if gone is None else gone.unionByName(out)
        bars = stage(bars.join(out.select("asset", "hour"), ["asset", "hour"], "left_anti"), "bars")
    return gone if gone is not None else out


@query("I8_recount_due", f"""WITH {TALLY} SELECT asset, hour, (hour // 86400 + 1 + CASE WHEN (hour // 86400 + 4) % 7 IN (5, 6) THEN 1 ELSE 0 END) *
  86400 + 75600 AS due FROM tally WHERE verdict = 'uncertain'""")
def i8(spark, sf):
    """An uncertain vote is taken again at the next session's end."""
    d = F.floor(F.col("hour") / 86400)
    late = F.when(F.pmod(d + 4, F.lit(7)).isin(5, 6), 1).otherwise(0)
    return tally(spark, sf).where("verdict = 'uncertain'").select("asset", "hour", ((d + 1 + late) * 86400 + 75600).alias("due"))


@query("B13_voter_eligible", f"""WITH {FEED_BARS} SELECT asset, feed, count(*) FILTER (NOT list_contains([[3, 4], [5], []][feed + 1], hour // 3600 %
  24)) AS n_served, count(*) AS n FROM fbars GROUP BY 1, 2""")
def b13(spark, sf):
    """Feeds skip hours of their lists: a broadcast dimension with an array column."""
    b = market.feed_bars(spark, sf).join(F.broadcast(skipped(spark)), "feed")
    return (
        b.groupBy("asset", "feed")
        .agg(F.count_if(~F.array_contains("skip", (F.floor(F.col("hour") / 3600) % 24).cast("int"))).alias("n_served"), F.count(F.lit(1)).alias("n"))
    )


@query("A12_vote_record", f"""WITH {TALLY} SELECT asset, hour, CASE verdict WHEN 'real' THEN 'confirmed' WHEN 'not real' THEN 'rejected' ELSE verdict
  END AS verdict, seen FROM tally WHERE verdict <> 'uncertain' OR hour >= (SELECT max(hour) FROM tally) - 10 * 86400""")
def a12(spark, sf):
    """Record of votes: verdicts recoded; settled ones kept for good, others ten days."""
    t = tally(spark, sf)
    newest = t.agg((F.max("hour") - 10 * 86400).alias("from"))
    recoded = F.when(F.col("verdict") == "real", "confirmed").when(F.col("verdict") == "not real", "rejected").otherwise(F.col("verdict"))
    return (
        t.crossJoin(F.broadcast(newest)).where("verdict <> 'uncertain' or hour >= `from`").select("asset", "hour", recoded.alias("verdict"), "seen")
    )


@query("D16_verify_alignment", f"""WITH {FEED_BARS}, bars AS (SELECT asset, t // 3600 * 3600 AS hour, {FOLD} FROM ticks GROUP BY 1, 2),
j AS (SELECT b.asset, f.feed, b.hour, b.close AS a, f.close AS b FROM bars b JOIN fbars f USING (asset, hour) WHERE b.close > 0 AND f.close > 0),
k AS (SELECT *, ln(a / lag(a) OVER w) AS da, ln(b / lag(b) OVER w) AS db, abs(ln(b / a)) * 1e4 AS gap, row_number() OVER (PARTITION BY asset, feed
  ORDER BY round(abs(ln(b / a)) * 1e4, 6) DESC, hour) AS nth FROM j WINDOW w AS (PARTITION BY asset, feed ORDER BY hour)),
g AS (SELECT asset, feed, count(*) AS n, corr(da, db) AS c, median(gap) AS m, string_agg(hour::VARCHAR, ',' ORDER BY hour) FILTER (nth <= 3) AS
  worst_hours FROM k GROUP BY 1, 2)
SELECT asset, feed, n, round(c, 6) AS corr, round(m, 4) AS gap_bp, worst_hours, coalesce(n >= 200 AND c >= 0.9 AND m <= 25, FALSE) AS passes,
  coalesce(n >= 200 AND c >= 0.1 AND m <= 9000, FALSE) AS passes_loosely FROM g""")
def d16(spark, sf):
    """Each feed against the store by the default gate, and by a loose one."""
    b, f = market.bars(spark, sf), market.feed_bars(spark, sf)
    feeds = spark.range(market.FEEDS).select(F.col("id").alias("feed"))
    a = vote.alignment(b.crossJoin(F.broadcast(feeds)), f, ["asset", "feed"])  # a handful of feeds
    loose = F.coalesce((F.col("n") >= 200) & (F.col("corr") >= 0.1) & (F.col("gap_bp") <= 9000), F.lit(False))
    hours = F.array_join(F.transform("worst_hours", lambda h: h.cast("string")), ",")
    return a.select(
        "asset", "feed", "n", r6("corr"), F.round("gap_bp", 4).alias("gap_bp"), hours.alias("worst_hours"), "passes", loose.alias("passes_loosely"),
    )


@query("D22_failure_spells", f"""WITH {JUDGED}, x AS (SELECT asset, feed, hour, answer = 'unknown' AS bad, lag(answer = 'unknown') OVER w AS was FROM
  judged WINDOW w AS (PARTITION BY asset, feed ORDER BY hour)),
s AS (SELECT *, sum(CASE WHEN bad AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY asset, feed ORDER BY hour) AS spell FROM x WHERE
  bad)
SELECT asset, feed, min(hour) AS opened, max(hour) AS last, count(*) AS n FROM s GROUP BY asset, feed, spell""")
def d22(spark, sf):
    """Spells in which a feed had no answer."""
    w = Window.partitionBy("asset", "feed").orderBy("hour")
    x = judged(spark, sf).withColumn("bad", F.col("answer") == "unknown").withColumn("was", F.lag("bad").over(w)).where("bad")
    s = x.withColumn("spell", F.sum((~F.coalesce("was", F.lit(False))).cast("int")).over(w))
    return (
        s.groupBy("asset", "feed", "spell").agg(F.min("hour").alias("opened"), F.max("hour").alias("last"), F.count(F.lit(1)).alias("n"))
        .drop("spell")
    )


@query("D22_failures_told", f"""WITH RECURSIVE {JUDGED}, k AS (SELECT asset, feed, hour, answer = 'unknown' AS bad, row_number() OVER (PARTITION BY asset, feed ORDER BY
  hour) AS i FROM judged),
s(asset, feed, i, hour, bad, since, last, told_at, told) AS (
  SELECT DISTINCT asset, feed, 0::BIGINT, NULL::BIGINT, FALSE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, FALSE FROM k
  UNION ALL
  SELECT asset, feed, i, hour, bad, CASE WHEN bad THEN first END, CASE WHEN bad THEN hour END, CASE WHEN bad AND named THEN hour WHEN bad THEN before END, bad AND named
  FROM (SELECT *, hour - first >= 43200 AND (before IS NULL OR hour - before >= 86400) AS named FROM (
    SELECT k.asset, k.feed, k.i, k.hour, k.bad, CASE WHEN s.since IS NOT NULL AND k.hour - s.last <= 259200 THEN s.since ELSE k.hour END AS first,
      CASE WHEN s.since IS NOT NULL AND k.hour - s.last <= 259200 THEN s.told_at END AS before FROM s JOIN k ON k.asset = s.asset AND k.feed = s.feed AND k.i = s.i + 1)))
SELECT asset, feed, hour, since, told FROM s WHERE bad""")
def d22_told(spark, sf):
    """Spells of failures with what is said of them: opened, gone on with, forgotten, and named once a day at most."""
    answers = judged(spark, sf).select("asset", "feed", "hour", (F.col("answer") == "unknown").alias("bad"))
    return vote.failures_told(answers).where("bad").select("asset", "feed", "hour", "since", "told")
