"""Registered streaming queries; their SQL is the batch result over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..queries.common import BARS, FEED_BARS, LEAST, SCORED, TICKS, WEEK
from ..registry import query
from ..sources import market
from . import events, messages


def _named(rows):
    """Yardsticks rounded; a bar without an instrument has none."""
    return rows.select("asset", "hour", F.when(F.col("asset").isNotNull(), F.round("sigma", 6)).alias("sigma"))


@query("H1_upsert_stream", f"WITH {FEED_BARS} SELECT asset, feed, hour, open, high, low, close, n_src FROM fbars")
def h1(spark, sf):
    """Late and split hours heal: batches of files merged into the store give the same bars as one fold."""
    return events.upsert_stream(events.tick_stream(spark, events.split_files(spark, sf, 4)), ["asset", "feed"])


@query("H4_hourly_stream", f"""WITH {BARS} SELECT asset, hour, open, high, low, close, n_src FROM bars WHERE hour + 3600 <= (SELECT max(t) - 10800
  FROM ticks)""")
def h4(spark, sf):
    """Tumbling hours under a three-hour watermark: those that the watermark has closed."""
    out = events.run_to_table(events.hourly_stream(events.tick_stream(spark, events.split_files(spark, sf, 4))), "append")
    return out.select("asset", F.unix_timestamp(F.col("window.start")).alias("hour"), "open", "high", "low", "close", "n_src")


@query("H5_sliding_stream", f"WITH {SCORED} SELECT asset, hour, round(sigma, 6) AS sigma FROM scored")
def h5(spark, sf):
    """The sliding yardstick, kept up to date by batches, is that of all bars at once."""
    ticks = events.tick_stream(spark, events.split_files(spark, sf, 4))
    return _named(events.sliding_stream(ticks, WEEK, LEAST))


@query("H6_event_stream", f"""WITH RECURSIVE {TICKS}, k AS (SELECT asset, event_id, t AS found, row_number() OVER (PARTITION BY asset ORDER BY t,
  event_id) AS i FROM ticks WHERE price > 60),
e AS (SELECT asset, event_id, found, i, found AS start FROM k WHERE i = 1 UNION ALL SELECT k.asset, k.event_id, k.found, k.i, CASE WHEN k.found <
  e.start + 86400 THEN e.start ELSE k.found END FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1)
SELECT asset, event_id, found, start AS event_start FROM e""")
def h6(spark, sf):
    return events.event_stream(events.tick_stream(spark, events.split_files(spark, sf, 4)))


@query("H10_action_stream", f"""WITH {TICKS}, k AS (SELECT asset, event_id, price, t // 86400 AS d, max(price) OVER (PARTITION BY asset, t // 86400
  ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks WHERE price > 60)
SELECT asset, event_id, CASE WHEN top IS NULL THEN 'post' WHEN price > top THEN 'edit' ELSE 'silent' END AS action FROM k""")
def h10(spark, sf):
    return events.action_stream(events.tick_stream(spark, events.split_files(spark, sf, 4)))


#: The replay in which one tick in eleven comes a week or two late: run is the slice that brings a tick.
LATE = f"""{TICKS}, dl AS (SELECT *, t // 604800 + CASE WHEN event_id % 11 = 0 THEN 1 + event_id % 2 ELSE 0 END AS run FROM ticks)"""


@query("H1_late_stream", f"WITH {FEED_BARS} SELECT asset, feed, hour, open, high, low, close, n_src FROM fbars")
def h1_late(spark, sf):
    """Ticks that come weeks late heal their hours."""
    return events.upsert_stream(events.late_ticks(spark, sf), ["asset", "feed"])


@query("H4_late_stream", f"""WITH {LATE}, seen AS (SELECT run, max(max(t)) OVER (ORDER BY run) AS newest FROM dl GROUP BY 1),
marks AS (SELECT run, lag(newest, 2) OVER (ORDER BY run) - 10800 AS dropped FROM seen),
kept AS (SELECT dl.*, t // 3600 * 3600 AS hour FROM dl JOIN marks USING (run) WHERE dropped IS NULL OR t // 3600 * 3600 + 3600 > dropped)
SELECT asset, hour, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, count(*) AS n_src FROM kept
GROUP BY asset, hour HAVING hour + 3600 <= (SELECT max(t) - 10800 FROM ticks)""")
def h4_late(spark, sf):
    """Under a watermark of three hours, a tick counts as long as its hour was not closed before its batch began; later ones are dropped."""
    out = events.run_to_table(events.hourly_stream(events.late_ticks(spark, sf)), "append")
    return out.select("asset", F.unix_timestamp(F.col("window.start")).alias("hour"), "open", "high", "low", "close", "n_src")


@query("H5_late_stream", f"WITH {SCORED} SELECT asset, hour, round(sigma, 6) AS sigma FROM scored")
def h5_late(spark, sf):
    """Late ticks change bars, products and yardsticks of their time; the yardsticks kept up to date are those of all bars at once."""
    return _named(events.sliding_stream(events.late_ticks(spark, sf), WEEK, LEAST))


@query("H6_late_stream", f"""WITH RECURSIVE {LATE}, k AS (SELECT asset, event_id, t, run, row_number() OVER (PARTITION BY asset ORDER BY run, t, event_id) AS i
  FROM dl WHERE price > 60),
e(asset, event_id, t, i, run, fixed, own, current, start) AS (
  SELECT DISTINCT asset, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM k
  UNION ALL
  SELECT asset, event_id, t, i, run, fixed, CASE WHEN start = t AND held IS NULL AND own_current IS NULL THEN list_append(own, t) ELSE own END,
    CASE WHEN held IS NULL AND own_current IS NULL AND ahead IS NULL THEN t ELSE current END, start
  FROM (SELECT *, coalesce(held, own_current, ahead, t) AS start FROM (
    SELECT *, CASE WHEN t < current + 86400 THEN current END AS own_current, list_min(list_filter(fixed, lambda x: x <= t AND t < x + 86400)) AS held,
      list_min(list_filter(fixed, lambda x: x > t AND x <= t + 86400)) AS ahead FROM (
      SELECT k.asset, k.event_id, k.t, k.i, k.run, CASE WHEN k.run = e.run THEN e.fixed ELSE list_concat(e.fixed, e.own) END AS fixed,
        CASE WHEN k.run = e.run THEN e.own ELSE []::BIGINT[] END AS own, CASE WHEN k.run = e.run THEN e.current END AS current
      FROM e JOIN k ON k.asset = e.asset AND k.i = e.i + 1))))
SELECT asset, event_id, t AS found, start AS event_start FROM e WHERE i > 0""")
def h6_late(spark, sf):
    """A late tick belongs to the event that holds it, or to one at most a day ahead, or opens its own: never to one that began after it for good."""
    return events.event_stream(events.late_ticks(spark, sf))


_LARGEST = "list_sort(list_transform(list_filter({l}, lambda x: {c}), lambda x: {{'s': x.size, 'h': -x.hour}}), 'DESC')[1]"
_RANK = "((({x}) > 60)::INT + (({x}) > 90)::INT + (({x}) > 120)::INT + (({x}) > 180)::INT)"


@query("H10_message_stream", f"""WITH RECURSIVE {LATE.replace('604800', '345600')}, rr AS (SELECT asset, t // 3600 * 3600 AS hour, run, arg_max(price, event_id) AS p, max(event_id) AS e,
  max(t) AS newest FROM dl GROUP BY 1, 2, 3),
ck AS (SELECT run, max(max(newest)) OVER w AS clock, max(max(hour // 864000 + 1)) OVER w * 864000 - 432000 AS mark FROM rr GROUP BY run
  WINDOW w AS (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT run, clock, lag(mark) OVER (ORDER BY run) AS dropped FROM ck),
rv AS (SELECT asset, hour, hour // 864000 AS event, run, arg_max(p, e) OVER (PARTITION BY asset, hour ORDER BY run) AS p FROM rr),
kept AS (SELECT asset, hour, event, run, clock, CASE WHEN p > 60 THEN p END AS size FROM rv JOIN cl USING (run) WHERE dropped IS NULL OR (event + 1) * 864000 >
  dropped),
born AS (SELECT asset, hour, min(run) AS born FROM kept WHERE size IS NOT NULL GROUP BY 1, 2),
er AS (SELECT DISTINCT asset, event, run, clock FROM kept),
ma AS (SELECT er.*, k.hour, k.size, k.run = er.run AND k.size IS DISTINCT FROM lag(k.size) OVER (PARTITION BY er.asset, er.event, er.run, k.hour ORDER BY k.run) AS
  moved, row_number() OVER (PARTITION BY er.asset, er.event, er.run, k.hour ORDER BY k.run DESC) AS nth FROM er JOIN kept k ON k.asset = er.asset AND k.event = er.event
  AND k.run <= er.run),
ms AS (SELECT ma.asset, event, run, list({{'hour': hour, 'size': size, 'moved': moved, 'new': born = run AND (clock IS NULL OR hour + 3600 > clock)}})
  FILTER (size IS NOT NULL) AS ms FROM ma LEFT JOIN born USING (asset, hour) WHERE nth = 1 GROUP BY 1, 2, 3),
st AS (SELECT asset, event, run, coalesce(ms, []) AS ms, row_number() OVER (PARTITION BY asset, event ORDER BY run) AS i FROM ms),
a(asset, event, i, run, sh, ss, struck, acts) AS (
  SELECT DISTINCT asset, event, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, FALSE, []::STRUCT(action VARCHAR, hour BIGINT, size DOUBLE, old BIGINT)[] FROM st
  UNION ALL
  SELECT asset, event, i, run, CASE WHEN top IS NOT NULL THEN -top.h ELSE h2 END, CASE WHEN top IS NOT NULL THEN top.s ELSE s2 END, top IS NULL AND k2,
    list_concat(CASE WHEN strike THEN [{{'action': 'strike', 'hour': sh, 'size': ss, 'old': NULL::BIGINT}}] ELSE [] END,
      CASE WHEN shift IS NOT NULL THEN [{{'action': 'correct', 'hour': h2, 'size': s2, 'old': NULL::BIGINT}}] ELSE [] END,
      CASE WHEN top IS NOT NULL THEN [{{'action': CASE WHEN sh IS NULL OR k2 OR {_RANK.format(x='top.s')} > {_RANK.format(x='s2')} THEN 'post' ELSE 'edit' END,
        'hour': -top.h, 'size': top.s, 'old': h2}}] ELSE [] END)
  FROM (SELECT *, CASE WHEN sh IS NULL THEN CASE WHEN len(list_filter(ms, lambda x: x.new)) > 0 THEN {_LARGEST.format(l='ms', c='TRUE')} END
      ELSE {_LARGEST.format(l='ms', c='x.new AND (x.size > s2 OR k2)')} END AS top FROM (
    SELECT *, CASE WHEN shift IS NOT NULL THEN -shift.h ELSE sh END AS h2, CASE WHEN shift IS NOT NULL THEN shift.s ELSE ss END AS s2,
      shift IS NULL AND (struck OR strike) AS k2 FROM (
      SELECT *, coalesce(late, own) AS shift, sh IS NOT NULL AND cur IS NULL AND own IS NULL AND late IS NULL AND NOT struck AS strike FROM (
        SELECT *, CASE WHEN sh IS NOT NULL THEN {_LARGEST.format(l='ms', c='NOT x.new AND x.moved AND x.hour <> sh AND x.size > coalesce(cur, own.s, ss)')} END AS late
        FROM (SELECT *, CASE WHEN sh IS NULL THEN NULL WHEN cur IS NULL THEN {_LARGEST.format(l='ms', c='NOT x.new')}
            WHEN struck OR cur <> ss THEN {{'s': cur, 'h': -sh}} END AS own FROM (
          SELECT st.*, a.sh, a.ss, a.struck, list_filter(st.ms, lambda x: x.hour = a.sh)[1].size AS cur FROM a JOIN st ON st.asset = a.asset AND st.event = a.event
            AND st.i = a.i + 1))))))),
acts AS (SELECT asset, event, run, unnest(acts) AS act FROM a),
parts AS (SELECT asset, event, run, act.old AS hour FROM acts WHERE act.action = 'post' AND act.old IS NOT NULL),
rev AS (SELECT asset, hour, run, size, lag(size) OVER (PARTITION BY asset, hour ORDER BY run) AS was FROM kept),
ends AS (SELECT asset, event, arg_max({{'h': sh, 's': ss}}, i) AS z FROM a WHERE sh IS NOT NULL AND (event + 1) * 864000 <= (SELECT max(hour // 864000 + 1) * 864000 - 432000
  FROM rr) GROUP BY 1, 2),
told AS (SELECT asset, event, run, act.action AS action, act.hour AS hour, act.size AS size FROM acts
  UNION ALL SELECT p.asset, event, rev.run, CASE WHEN size IS NULL THEN 'strike' ELSE 'correct' END, rev.hour, coalesce(size, was) FROM parts p JOIN rev
    ON rev.asset = p.asset AND rev.hour = p.hour AND rev.run > p.run AND size IS DISTINCT FROM was
  UNION ALL SELECT asset, event, NULL, 'expire', z.h, z.s FROM ends)
SELECT asset, event, run, action, hour, size, CASE {_RANK.format(x='size')} WHEN 4 THEN 'extreme' WHEN 3 THEN 'rare' WHEN 2 THEN 'large' ELSE 'notable' END AS word
FROM told""")
def h10_messages(spark, sf):
    """New messages, edits, corrections, strikes and ends of events, from state kept by key with timers."""
    rows = messages.revised(market.ticks(spark, sf).withColumn("run", events.delivered(messages.RUN)))
    path = events.in_slices(rows, "run", "revisions")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return messages.actions(stream)
