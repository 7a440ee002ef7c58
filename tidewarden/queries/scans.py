"""The store: scans, upserts, gates, calendars, ingest operators, versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bars as ob
from ..operators import calendar, quality, store, vote, windows
from ..registry import query
from ..sources import candlefiles, market
from ..sources.staging import exists, new_path, stage
from .common import BARS, FEED_BARS, TICKS, r6

epoch, table = market.epoch, market.table
BAR = T.StructType([T.StructField("hour", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in (
    "open", "high", "low", "close", "volume",
)] + [T.StructField("n_src", T.LongType())])


def sharded(spark, sf):
    """A store of bars: shards of whole ten-day spans, and of single days that were delivered after them. A span and its days
    both exist where a write ended between laying down the days and removing the span. The last days are CSV."""
    b = market.bars(spark, sf).withColumn("day", F.floor(F.col("hour") / 86400))
    span = F.concat(F.lit("span-"), F.floor(F.col("day") / 10).cast("string"))
    one = F.concat(span, F.lit("-"), F.col("day").cast("string"))
    old, new = new_path(spark, "settled"), new_path(spark, "open")
    later = b.where("day % 10 >= 5").withColumn("close", F.col("close") + 1).withColumn("shard", one)
    b.withColumn("shard", span).unionByName(later.where("day % 2 = 0")).write.partitionBy("asset", "day", "shard").parquet(old)
    later.where("day % 2 = 1").write.partitionBy("asset", "day", "shard").option("header", True).csv(new)
    return old, new


_STORE = f"""{BARS}, store AS (SELECT asset, hour, open, CASE WHEN hour // 86400 % 10 >= 5 THEN close + 1 ELSE close END AS close, n_src, hour //
  86400 % 10 >= 5 AS of_a_day FROM bars)"""


def load(spark, sf, since_day=None):
    """Of copies of a bar, that of the last shard stays: by span, a whole span before its days, days in order."""
    old, new = sharded(spark, sf)
    parts = T.StructType([
        *BAR.fields, *(T.StructField(n, t) for n, t in (("asset", T.StringType()), ("day", T.LongType()), ("shard", T.StringType())))
    ])
    both = spark.read.schema(parts).parquet(old).unionByName(spark.read.schema(parts).option("header", True).option("mode", "FAILFAST").csv(new))
    if since_day is not None:
        both = both.where(F.col("day") >= since_day)  # partition pruning
    name = F.split("shard", "-")
    both = (
        both.withColumn("span", F.get(name, F.lit(1)).cast("long"))
        .withColumn("of_day", F.coalesce(F.get(name, F.lit(2)).cast("long"), F.lit(-1).cast("long")))
    )
    return ob.keep_last(both, ["asset", "hour"], F.desc("span"), F.desc("of_day"))


@query("A1_load_store", f"WITH {_STORE} SELECT asset, hour, round(open, 6) AS open, round(close, 6) AS close, n_src FROM store")
def a1(spark, sf):
    """Union of Parquet and CSV shards; of copies the last shard's stays."""
    return load(spark, sf).select("asset", "hour", r6("open"), r6("close"), "n_src")


@query("A2_shard_precedence", f"WITH {_STORE} SELECT asset, count(*) AS n, count(*) FILTER (of_a_day) AS n_from_days FROM store GROUP BY 1")
def a2(spark, sf):
    """How many bars come from shards of a day."""
    return load(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("of_day") >= 0).alias("n_from_days"))


@query("A3_pruned_since", f"WITH {_STORE} SELECT asset, hour, round(close, 6) AS close FROM store WHERE hour // 86400 >= 19738")
def a3(spark, sf):
    return load(spark, sf, since_day=19738).select("asset", "hour", r6("close"))


@query("A4_typed_csv_round_trip", f"WITH {BARS} SELECT asset, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY 1")
def a4(spark, sf):
    path = new_path(spark, "csv")
    market.bars(spark, sf).select("asset", *BAR.fieldNames()).write.option("header", True).csv(path)
    back = (
        spark.read.schema(T.StructType([T.StructField("asset", T.StringType()), *BAR.fields])).option("header", True).option("mode", "FAILFAST")
        .csv(path)
    )
    return back.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


def revised(b):
    """A new delivery: hours divisible by 5 revised, those by 7 new (held back from the store), days before 19735 settled."""
    store = b.where(F.floor(F.col("hour") / 3600) % 7 != 0).withColumn("close", F.when(F.floor(F.col("hour") / 3600) % 11 != 0, F.col("close")))
    new = b.where((F.floor(F.col("hour") / 3600) % 5 == 0) | (F.floor(F.col("hour") / 3600) % 7 == 0)).withColumn("close", F.col("close") + 1)
    return store, new


_MERGE = f"""{BARS}, st AS (SELECT asset, hour, n_src, CASE WHEN hour // 3600 % 11 <> 0 THEN close END AS close FROM bars WHERE hour // 3600 % 7 <>
  0),
nw AS (SELECT asset, hour, n_src, close + 1 AS close FROM bars WHERE hour // 3600 % 5 = 0 OR hour // 3600 % 7 = 0),
merged AS (SELECT asset, hour, CASE WHEN st.hour IS NOT NULL AND (nw.hour IS NULL OR st.close IS NULL OR hour // 86400 < 19735) THEN st.close ELSE
  nw.close END AS close, st.hour IS NULL AS added FROM (SELECT *, hour AS h FROM st) st FULL JOIN nw USING (asset, hour))"""


def merged(spark, sf):
    store, new = revised(market.bars(spark, sf).select("asset", "hour", "n_src", "close"))
    return store, new, ob.upsert(store, new, ["asset", "hour"], F.floor(F.col("hour") / 86400) < 19735)


@query("A7_upsert", f"WITH {_MERGE} SELECT asset, hour, round(close, 6) AS close FROM merged")
def a7(spark, sf):
    return merged(spark, sf)[2].select("asset", "hour", r6("close"))


@query("A7_upsert_twice", f"WITH {_MERGE} SELECT asset, count(*) AS n, 0::BIGINT AS n_different FROM merged GROUP BY 1")
def a7b(spark, sf):
    """Merging the same delivery again changes nothing."""
    _, new, once = merged(spark, sf)
    twice = ob.upsert(once, new, ["asset", "hour"], F.floor(F.col("hour") / 86400) < 19735).select("asset", "hour", F.col("close").alias("again"))
    return (
        once.join(twice, ["asset", "hour"], "full").groupBy("asset")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("close").eqNullSafe(F.col("again"))).alias("n_different"))
    )


@query("A5_changed_partitions", f"""WITH {_MERGE}, a AS (SELECT hour // 86400 AS day, asset, hour, close FROM st), b AS (SELECT hour // 86400 AS day,
  asset, hour, close FROM merged) SELECT DISTINCT day FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM
  a))""")
def a5(spark, sf):
    """Only partitions whose rows differ are written again."""
    store, _, now = merged(spark, sf)
    day = F.floor(F.col("hour") / 86400)
    cols = lambda df: df.select("asset", "hour", "close", day.alias("day"))
    return ob.changed_partitions(cols(store), cols(now), "day")


@query("A5_overwrite_changed", f"WITH {_MERGE} SELECT asset, count(*) AS n, round(sum(close), 4) AS total FROM merged GROUP BY 1")
def a5b(spark, sf):
    """Dynamic overwrite of the changed partitions gives the merged store."""
    store, _, now = merged(spark, sf)
    day = F.floor(F.col("hour") / 86400)
    store, now = stage(
        store.withColumn("day", day), "store",
    ).select("asset", "hour", "close", "day"), stage(now.withColumn("day", day), "merged").select("asset", "hour", "close", "day")
    path = new_path(spark, "partitions")
    store.write.partitionBy("day").parquet(path)
    part = now.join(ob.changed_partitions(store, now, "day"), "day", "left_semi")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.parquet(path).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("A6_settled_layout", """WITH o AS (SELECT epoch_us(date_trunc('month', o_orderdate)) // 1000000 AS m, epoch_us(date_trunc('month', o_orderdate)
  + INTERVAL 1 MONTH) // 1000000 + 7 * 86400 AS closes, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT m, n, closes <= (SELECT max(epoch_us(o_orderdate) // 1000000) FROM orders) AS settled FROM o""")
def a6(spark, sf):
    """Months close seven days after their end, by the newest row."""
    o = (
        table(spark, sf, "orders")
        .select(
            epoch("o_orderdate").alias("t"), epoch("date_trunc('MONTH', o_orderdate)").alias("m"),
            epoch("date_trunc('MONTH', o_orderdate) + INTERVAL '1' MONTH").alias("e"),
        )
    )
    newest = o.agg(F.max("t").alias("newest"))
    g = o.groupBy("m", "e").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(newest))
    return g.select("m", "n", (F.col("e") + 7 * 86400 <= F.col("newest")).alias("settled"))


@query("A6_shards_by_year", """WITH o AS (SELECT o_orderkey, o_orderdate AS d, max(o_orderdate) OVER () AS newest FROM orders),
k AS (SELECT * FROM o WHERE date_trunc('month', d) <> date_trunc('month', newest) - INTERVAL 2 MONTH)
SELECT CASE WHEN date_trunc('year', d) + INTERVAL 1 YEAR + INTERVAL 7 DAY <= newest THEN strftime(d, '%Y') ELSE strftime(d, '%Y-%m') END AS shard, count(*) AS n,
  sum(o_orderkey)::BIGINT AS total FROM k GROUP BY 1""")
def a6_shards(spark, sf):
    """A store written up to the middle of the orders, then with all of them but one month's: settled years are folded, and the shard left without rows is gone."""
    o = table(spark, sf, "orders").select("o_orderkey", epoch("o_orderdate").alias("t"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    o = stage(o, "orders")
    ends = o.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.date_format(F.add_months(F.max(F.to_date(F.concat("month", F.lit("-01")))), -2), "yyyy-MM").alias("gone")).first()
    path, rows = new_path(spark, "shards"), o.drop("month")
    if ends["lo"] is None:
        return spark.createDataFrame([], "shard string, n long, total long")
    store.write_shards(rows.where(F.col("t") <= (ends["lo"] + ends["hi"]) // 2), path)
    store.write_shards(rows, path)
    store.write_shards(o.where(F.col("month") != ends["gone"]).drop("month"), path)
    return store.read_shards(spark, path, rows.schema).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("A8_removed_bars", f"WITH {_MERGE} SELECT asset, count(*) FILTER (close IS NULL) AS removed FROM merged GROUP BY 1")
def a8(spark, sf):
    return merged(spark, sf)[2].groupBy("asset").agg(F.count_if(F.col("close").isNull()).alias("removed"))


@query("A9_candles_to_frame", f"WITH {TICKS} SELECT asset, t AS open_time, price AS open, t + 60 AS close_time FROM ticks")
def a9(spark, sf):
    return market.ticks(spark, sf).select("asset", F.col("t").alias("open_time"), F.col("price").alias("open"), (F.col("t") + 60).alias("close_time"))


@query("A10_sessions_csv", """WITH d AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events UNION SELECT DISTINCT epoch_us(o_orderdate) //
  86400000000 FROM orders),
t AS (SELECT day, make_timestamp(day * 86400000000 + 34200000000) AS o, make_timestamp(day * 86400000000 + 57600000000) AS c FROM d WHERE (day + 4) %
  7 BETWEEN 1 AND 5)
SELECT day, epoch_us(o AT TIME ZONE 'America/New_York') // 1000000 AS open_at, epoch_us(c AT TIME ZONE 'America/New_York') // 1000000 AS close_at FROM
  t""")
def a10(spark, sf):
    """Sessions of the days of ticks and orders, generated from New York clock times (summer time counts), written as CSV and read back."""
    days = market.ticks(spark, sf).select(F.floor(F.col("t") / 86400).alias("day"))
    days = days.union(table(spark, sf, "orders").select(F.floor(epoch("o_orderdate") / 86400))).distinct()
    path = new_path(spark, "sessions")
    calendar.generate_sessions(days, "America/New_York", "09:30", "16:00").write.option("header", True).csv(path)
    return spark.read.schema("day long, open_at long, close_at long").option("header", True).option("mode", "FAILFAST").csv(path)


@query("A11_actions_csv", "SELECT l_orderkey, l_linenumber, l_tax AS step FROM lineitem WHERE l_linenumber <> 3")
def a11(spark, sf):
    """Malformed rows of a CSV dimension are skipped."""
    path = new_path(spark, "actions")
    li = table(spark, sf, "lineitem")
    bad = F.when(F.col("l_linenumber") == 3, "not a number").otherwise(F.col("l_tax").cast("string"))
    li.select("l_orderkey", "l_linenumber", bad.alias("step")).write.option("header", True).csv(path)
    return spark.read.schema("l_orderkey long, l_linenumber int, step double").option("header", True).option("mode", "DROPMALFORMED").csv(path)


@query("A13_usage_files", "SELECT l_returnflag AS provider, count(*) AS rows, sum(l_quantity::BIGINT)::BIGINT AS calls FROM lineitem GROUP BY 1")
def a13(spark, sf):
    """A glob of CSV files with comment lines, aggregated."""
    path = new_path(spark, "usage")
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_quantity").cast("long").cast("string").alias("calls"))
    lines = li.select(F.concat_ws(",", "provider", "calls").alias("value"))
    lines.unionByName(li.limit(5).select(F.lit("# a note").alias("value"))).write.text(path)
    back = spark.read.schema("provider string, calls long").option("comment", "#").csv(f"{path}/*.txt")
    return back.groupBy("provider").agg(F.count(F.lit(1)).alias("rows"), F.sum("calls").alias("calls"))


@query("A14_merge_releases", """WITH o AS (SELECT lang AS country, source AS title, doc_id % 50 AS slot, max(CASE WHEN doc_id % 3 = 0 THEN
  n_chars::VARCHAR ELSE '' END) AS actual FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2, 3),
n AS (SELECT lang AS country, source AS title, doc_id % 50 AS slot, max(CASE WHEN doc_id % 5 = 0 THEN n_chars::VARCHAR ELSE ' ' END) AS actual FROM
  documents GROUP BY 1, 2, 3)
SELECT country, title, slot, coalesce(nullif(trim(n.actual), ''), nullif(o.actual, '')) AS actual FROM o FULL JOIN n USING (country, title, slot)""")
def a14(spark, sf):
    """Releases as JSON lines; an empty field never overwrites a filled one."""
    d = table(spark, sf, "documents").withColumn("slot", F.col("doc_id") % 50)
    of = lambda rows, k, empty: rows.groupBy(
        F.col("lang").alias("country"), F.col("source").alias("title"), "slot",
    ).agg(F.max(F.when(F.col("doc_id") % k == 0, F.col("n_chars").cast("string")).otherwise(empty)).alias("actual"))
    path = new_path(spark, "releases")
    of(d.where("doc_id % 2 = 0"), 3, "").write.json(path)
    old = spark.read.schema("country string, title string, slot long, actual string").json(path).withColumnRenamed("actual", "a")
    new = of(d, 5, " ").withColumnRenamed("actual", "b")
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return (
        old.join(new, ["country", "title", "slot"], "full").select("country", "title", "slot", F.coalesce(filled("b"), filled("a")).alias("actual"))
    )


@query("A16_state_document", "SELECT event_type AS k, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def a16(spark, sf):
    """Run state as JSON, read strictly: a corrupt document is refused."""
    path = new_path(spark, "state")
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    s.select(F.to_json(F.struct("k", F.struct("n", "last").alias("v"))).alias("value")).write.text(path)
    back = spark.read.schema("k string, v struct<n: long, last: long>").option("mode", "FAILFAST").json(path)
    return back.select("k", "v.n", "v.last")


def read_or_empty(spark, path, schema):
    """The Parquet table at path, or an empty one where it was never written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


@query("A17_absent_is_empty", "SELECT event_type AS reading_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def a17(spark, sf):
    """Deliveries of two instruments' ledgers, one of which was never written and reads as an empty one."""
    path = new_path(spark, "ledger")
    e = table(spark, sf, "events").select(F.col("event_type").alias("reading_id"))
    e.where("reading_id <> 'error'").write.parquet(f"{path}/others")
    both = read_or_empty(spark, f"{path}/others", e.schema).unionByName(read_or_empty(spark, f"{path}/error", e.schema))
    return both.groupBy("reading_id").agg(F.count(F.lit(1)).alias("n"))


@query("A18_hot_and_cold", f"""WITH {BARS}, c AS (SELECT asset, hour, close, (hour // 86400 // 7 + 1) * 7 * 86400 + 3 * 86400 <= (SELECT max(hour)
  FROM bars) AS cold FROM bars),
held AS (SELECT DISTINCT asset FROM c WHERE NOT cold) SELECT asset, cold, count(*) AS n, round(sum(CASE WHEN cold THEN close ELSE close + 1 END), 4)
  AS total, asset IN (SELECT asset FROM held) AS is_held FROM c GROUP BY 1, 2""")
def a18(spark, sf):
    """Weeks settle three days after their end, by the newest bar. Settled ones are read from the cold tier, open ones from the hot tier, which is
    newer; an instrument is held where the hot tier has it. Rows that the cold tier has of open weeks give way."""
    b = market.bars(spark, sf)
    newest = b.agg(F.max("hour").alias("newest"))
    week = F.floor(F.col("hour") / (7 * 86400))
    b = b.crossJoin(F.broadcast(newest)).select("asset", "hour", "close", ((week + 1) * 7 * 86400 + 3 * 86400 <= F.col("newest")).alias("cold"))
    hot, cold = new_path(spark, "hot"), new_path(spark, "cold")
    b.write.parquet(cold)
    b.where("not cold").withColumn("close", F.col("close") + 1).write.parquet(hot)
    hot, cold = spark.read.schema(b.schema).parquet(hot), spark.read.schema(b.schema).parquet(cold)
    both = cold.join(hot, ["asset", "hour"], "left_anti").unionByName(hot)
    held = hot.select("asset").distinct().withColumn("held", F.lit(True))
    out = both.groupBy("asset", "cold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total")).join(held, "asset", "left")
    return out.select("asset", "cold", "n", "total", F.coalesce("held", F.lit(False)).alias("is_held"))


@query("A20_fetch_missing", f"""WITH {FEED_BARS}, newest AS (SELECT asset, max(hour) - 10800 AS since FROM fbars WHERE feed = 0 AND hour < 1706000000
  GROUP BY 1) SELECT f.asset, count(*) AS n, min(f.hour) AS first FROM fbars f JOIN newest USING (asset) WHERE feed = 1 AND f.hour >= since GROUP BY 1""")
def a20(spark, sf):
    """The window to ask for starts three hours before the newest stored bar."""
    f = market.feed_bars(spark, sf)
    newest = f.where("feed = 0 and hour < 1706000000").groupBy("asset").agg((F.max("hour") - 10800).alias("since"))
    return (
        f.where("feed = 1").join(newest, "asset").where("hour >= since").groupBy("asset")
        .agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("first"))
    )


@query("A21_request_batches", f"""WITH {BARS}, n AS (SELECT asset, hour // 86400 AS d, max(hour) AS newest, row_number() OVER (ORDER BY asset, hour //
  86400) AS i FROM bars GROUP BY 1, 2)
SELECT (i - 1) // 8 AS batch, count(*) AS n, min(newest) AS since FROM n GROUP BY 1""")
def a21(spark, sf):
    """Eight series a request; its lower bound is the least of the batch. Series are numbered within their instrument, after the instruments before."""
    n = market.bars(spark, sf).groupBy("asset", F.floor(F.col("hour") / 86400).alias("d")).agg(F.max("hour").alias("newest"))
    before = windows.counts_before(n, "asset")
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("d"))).join(before, "asset")
    return n.groupBy(F.floor((F.col("before") + F.col("i") - 1) / 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("newest").alias("since"))


_ALIGN = f"""{FEED_BARS}, s AS (SELECT * FROM fbars WHERE feed = 0 AND close > 0), v AS (SELECT * FROM fbars WHERE feed = 1 AND close > 0),
g AS (SELECT s.asset, count(*) AS n, median(abs(ln(v.close / s.close))) AS gap FROM s JOIN v USING (asset, hour) GROUP BY 1), ok AS (SELECT asset FROM
  g WHERE n >= 50 AND gap <= 1.2)"""


def agreeing(s, v):
    """asset of the instruments of which two feeds overlap in 50 hours or more with a small median gap."""
    j = s.select("asset", "hour", F.col("close").alias("a")).join(v.select("asset", "hour", F.col("close").alias("b")), ["asset", "hour"])
    gap = F.percentile(F.abs(F.ln(F.col("b") / F.col("a"))), 0.5)
    return j.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), gap.alias("gap")).where("n >= 50 and gap <= 1.2").select("asset")


@query("A22_gated_splice", f"""WITH {_ALIGN}, o AS (SELECT asset, min(hour) + 86400 AS oldest FROM s GROUP BY 1) SELECT v.asset, v.hour,
  round(v.close, 6) AS close FROM v JOIN o USING (asset) JOIN ok USING (asset) WHERE v.hour < oldest""")
def a22(spark, sf):
    """A deeper source only adds rows below the oldest stored, and only where the overlap agrees."""
    f = market.feed_bars(spark, sf).where("close > 0")
    s, v = f.where("feed = 0"), f.where("feed = 1")
    ok = agreeing(s, v)
    oldest = s.groupBy("asset").agg((F.min("hour") + 86400).alias("oldest"))
    return v.join(oldest, "asset").where("hour < oldest").join(ok, "asset", "left_semi").select("asset", "hour", r6("close"))


@query("A23_repair_missing", f"""WITH {_ALIGN} SELECT v.asset, v.hour, round(v.close, 6) AS close FROM v JOIN ok USING (asset) ANTI JOIN s USING
  (asset, hour)""")
def a23(spark, sf):
    """Only hours the store lacks, and only from a source that agrees."""
    f = market.feed_bars(spark, sf).where("close > 0")
    s, v = f.where("feed = 0"), f.where("feed = 1")
    ok = agreeing(s, v)
    return v.join(ok, "asset", "left_semi").join(s, ["asset", "hour"], "left_anti").select("asset", "hour", r6("close"))


@query("A24_fill_gaps", f"""WITH {_ALIGN}, miss AS (SELECT asset, hour FROM v ANTI JOIN s USING (asset, hour) WHERE asset IN (SELECT asset FROM ok))
  SELECT asset, count(*) AS filled FROM miss GROUP BY 1""")
def a24(spark, sf):
    """Hours that the store lacks, of instruments whose feeds agree."""
    f = market.feed_bars(spark, sf).where("close > 0")
    s, v = f.where("feed = 0"), f.where("feed = 1")
    return (
        v.join(agreeing(s, v), "asset", "left_semi").join(s, ["asset", "hour"], "left_anti").groupBy("asset").agg(F.count(F.lit(1)).alias("filled"))
    )


@query("A25_hours_by_end", f"""WITH {TICKS} SELECT event_id, ((least(t + 3600, (t // 86400) * 86400 + 75600) - 1) // 3600 * 3600)::BIGINT AS hour FROM
  ticks""")
def a25(spark, sf):
    """Half-hour stamps filed under the hour of their last minute, ends capped at the session's close."""
    t = F.col("t")
    return (
        market.ticks(spark, sf).select("event_id", (F.floor((F.least(t + 3600, F.floor(t / 86400) * 86400 + 75600) - 1) / 3600) * 3600).alias("hour"))
    )


@query("A26_trailing_hours", f"""WITH {FEED_BARS}, l AS (SELECT asset, hour // 86400 AS d, max(hour) AS last FROM fbars WHERE feed = 0 GROUP BY 1, 2)
  SELECT f.asset, f.hour, round(f.close, 6) AS close FROM fbars f JOIN l ON l.asset = f.asset AND l.d = f.hour // 86400 WHERE f.feed = 1 AND f.hour >
  l.last""")
def a26(spark, sf):
    """Hours after the first feed's last bar of a day come from the second."""
    f = market.feed_bars(spark, sf).withColumn("d", F.floor(F.col("hour") / 86400))
    last = f.where("feed = 0").groupBy("asset", "d").agg(F.max("hour").alias("last"))
    return f.where("feed = 1").join(last, ["asset", "d"]).where("hour > last").select("asset", "hour", r6("close"))


@query("A27_series_covered", """WITH d AS (SELECT o_orderstatus AS s, max(epoch_us(o_orderdate) // 1000000) AS newest FROM orders GROUP BY 1) SELECT
  s, newest, newest >= (SELECT max(newest) FROM d) AS covered FROM d""")
def a27(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.max(epoch("o_orderdate")).alias("newest"))
    top = d.agg(F.max("newest").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("s", "newest", (F.col("newest") >= F.col("top")).alias("covered"))


@query("A28_error_classes", """WITH a AS (SELECT user_id, event_id, CASE WHEN value IS NULL THEN 'no data' WHEN event_type <> 'error' THEN 'answered'
  WHEN value < 20 THEN 'key refused' WHEN value < 40 THEN 'day quota' WHEN value < 60 THEN 'rate limited' ELSE 'unreachable' END AS class FROM
  events),
b AS (SELECT *, class IN ('unreachable', 'no data') AS silent, lag(class IN ('unreachable', 'no data'), 1, FALSE) OVER w AS was FROM a WINDOW w AS
  (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, coalesce(bool_or(silent AND was OR class IN ('key refused', 'day quota')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stopped FROM b)
SELECT class, count(*) AS n, count(*) FILTER (class = 'rate limited') AS n_retried, count(*) FILTER (stopped) AS n_not_asked FROM c GROUP BY 1""")
def a28(spark, sf):
    """Answers of a provider by class. A refused key or a spent day's quota ends a user's requests, as do two silent answers one after another;
    a limited rate is asked again."""
    e, value = table(spark, sf, "events"), F.col("value")
    refused = F.when(value < 20, "key refused").when(value < 40, "day quota").when(value < 60, "rate limited").otherwise("unreachable")
    kind = F.when(value.isNull(), "no data").when(F.col("event_type") != "error", "answered").otherwise(refused)
    line = Window.partitionBy("user_id").orderBy("event_id")
    e = e.select("user_id", "event_id", kind.alias("class")).withColumn("silent", F.col("class").isin("unreachable", "no data"))
    ends = (F.col("silent") & F.lag("silent", 1, False).over(line)) | F.col("class").isin("key refused", "day quota")
    e = e.withColumn("ends", ends)
    stopped = F.coalesce(F.bool_or("ends").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    counts = F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "rate limited").alias("n_retried"), F.count_if(F.col("stopped")).alias("n_not_asked")
    return e.withColumn("stopped", stopped).groupBy("class").agg(*counts)


_MIDS = f"""WITH {BARS} SELECT asset AS symbol, hour AS t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n_src::DOUBLE AS
  volume FROM bars WHERE least(open, high, low, close) > 0.01"""


def archive(spark, sf):
    """An archive of bid and ask candles, a point to either side of the bars, with fillers at the hours without any."""
    b = market.bars(spark, sf).where(F.least("open", "high", "low", "close") > 0.01)
    b = b.select(F.col("asset").alias("symbol"), F.col("hour").alias("t"), "open", "high", "low", "close", F.col("n_src").cast("double").alias("volume"))
    side = lambda name, d: b.select("symbol", F.lit(name).alias("side"), "t", *((F.col(p) + d).alias(p) for p in candlefiles.PRICES), "volume")
    rows = stage(side("BID", -0.01).unionByName(side("ASK", 0.01)), "candles")
    empty = ob.expected_hours(rows, ["symbol", "side"], "t", 3600).join(rows.select("symbol", "side", "t"), ["symbol", "side", "t"], "left_anti")
    fill = empty.select("*", *(F.lit(1.0).alias(p) for p in candlefiles.PRICES), F.lit(0.0).alias("volume"))
    path = new_path(spark, "archive")
    candlefiles.write_candles(rows.unionByName(fill), path)
    return path


def _six(rows):
    return rows.select("symbol", "t", *(r6(p) for p in candlefiles.PRICES), "volume")


@query("A22_candle_files", _MIDS)
def a22_files(spark, sf):
    """Compressed binary candles written and read by a data source: both sides joined to mids, fillers dropped."""
    return _six(candlefiles.mids(spark.read.format("candle_files").load(archive(spark, sf))))


@query("A22_candle_stream", _MIDS)
def a22_stream(spark, sf):
    """The same archive as a stream of files."""
    from ..streaming.events import run_to_table

    return _six(candlefiles.mids(run_to_table(spark.readStream.format("candle_files").load(archive(spark, sf)), "append")))


@query("A29_expected_hours", f"""WITH {BARS}, d AS (SELECT DISTINCT asset, hour // 86400 AS d FROM bars), s AS (SELECT asset, d,
  unnest(generate_series(d * 86400 + 50400, d * 86400 + 72000, 3600)) AS hour FROM d WHERE (d + 4) % 7 BETWEEN 1 AND 5) SELECT s.asset, s.d, count(*)
  AS expected, count(b.hour) AS stored FROM s LEFT JOIN bars b ON b.asset = s.asset AND b.hour = s.hour GROUP BY 1, 2""")
def a29(spark, sf):
    """Session hours generated from the days, and how many of them are stored."""
    b = market.bars(spark, sf).select("asset", "hour")
    d = b.select("asset", F.floor(F.col("hour") / 86400).alias("d")).distinct().where(calendar.weekday(F.col("d")).between(1, 5))
    s = d.withColumn("hour", F.explode(F.sequence(F.col("d") * 86400 + 50400, F.col("d") * 86400 + 72000, F.lit(3600).cast("bigint"))))
    return (
        s.join(b.withColumn("has", F.lit(1)), ["asset", "hour"], "left").groupBy("asset", "d")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("has").alias("stored"))
    )


@query("B1_ohlc_inconsistent", f"""WITH {BARS} SELECT asset, hour, low > least(open, close) - 1 + 0.005 OR greatest(open, close) > high - 1 + 0.005 AS
  bad FROM bars WHERE n_src > 2""")
def b1(spark, sf):
    """Ranges narrowed by one, to find bars whose body leaves them."""
    b = market.bars(spark, sf).where("n_src > 2").withColumn("low", F.col("low") + 1).withColumn("high", F.col("high") - 1)
    return b.select("asset", "hour", quality.ohlc_inconsistent(0.01).alias("bad"))


@query("B2_invalid_reasons", f"""WITH {BARS} SELECT asset, hour, CASE WHEN hour // 3600 % 13 = 0 THEN 'removed' WHEN least(open, high, low, close) <=
  0 THEN 'not above zero' WHEN hour // 3600 % 17 = 0 AND low < high THEN 'body outside range' WHEN hour // 3600 % 19 = 0 THEN 'volume below zero' ELSE
  '' END AS reason FROM bars""")
def b2(spark, sf):
    """First rule broken; hours by 13, 17 and 19 are spoilt on purpose."""
    h = F.floor(F.col("hour") / 3600)
    b = (
        market.bars(spark, sf).withColumn("close", F.when(h % 13 != 0, F.col("close")))
        .withColumn("volume", F.when(h % 19 == 0, F.lit(-1.0)).otherwise(F.col("volume")))
    )
    b = b.withColumn("open", F.when((h % 17 == 0) & (F.col("low") < F.col("high")), F.col("high") + 1).otherwise(F.col("open")))
    return b.select("asset", "hour", quality.invalid_reason(0.01).alias("reason"))


#: The exchange's calendar by its rules, from the days in `span` (a, b: first and last day number): Easter by its tables, weekdays counted in each month.
SESSIONS = """cal AS (SELECT unnest(generate_series(a, b)) AS day FROM span), cd AS (SELECT day, DATE '1970-01-01' + day::INT AS d FROM cal),
yrs AS (SELECT DISTINCT year(d) AS y FROM cd), g AS (SELECT y, y // 100 AS c, y % 19 AS n FROM yrs),
g1 AS (SELECT *, (c - c // 4 - (c - (c - 17) // 25) // 3 + 19 * n + 15) % 30 AS i FROM g),
g2 AS (SELECT *, i - (i // 28) * (1 - (i // 28) * (29 // (i + 1)) * ((21 - n) // 11)) AS m FROM g1),
eas AS (SELECT y, make_date(y, 3, 28) + (m - (y + y // 4 + m + 2 - c + c // 4) % 7)::INT AS sunday FROM g2),
alld AS (SELECT DATE '1990-01-01' + x::INT AS d FROM (SELECT unnest(range(20000)) AS x)),
nth AS (SELECT d, year(d) AS y, month(d) AS mo, dayofweek(d) AS w, (day(d) - 1) // 7 + 1 AS n, month(d + 7) <> month(d) AS final FROM alld),
fix AS (SELECT d, y, CASE WHEN w = 0 THEN d + 1 WHEN w = 6 AND NOT (mo = 1) THEN d - 1 WHEN w = 6 THEN NULL ELSE d END AS kept FROM nth
  WHERE (mo = 1 AND day(d) = 1) OR (mo = 6 AND day(d) = 19 AND y >= 2022) OR (mo = 7 AND day(d) = 4) OR (mo = 12 AND day(d) = 25)),
shut AS (SELECT kept AS d FROM fix UNION SELECT sunday - 2 FROM eas UNION SELECT d FROM nth WHERE w = 1 AND ((mo = 1 AND n = 3 AND y >= 1998) OR (mo = 2 AND n = 3)
  OR (mo = 5 AND final) OR (mo = 9 AND n = 1)) UNION SELECT d FROM nth WHERE mo = 11 AND w = 4 AND n = 4),
half AS (SELECT d + 1 AS d FROM nth WHERE mo = 11 AND w = 4 AND n = 4 UNION SELECT d FROM nth WHERE w BETWEEN 1 AND 4 AND ((mo = 7 AND day(d) = 3) OR
  (mo = 12 AND day(d) = 24))),
sessions AS (SELECT day, epoch_us(timezone('America/New_York', d + TIME '09:30:00')) // 1000000 AS open_at, epoch_us(timezone('America/New_York', d + CASE WHEN d IN
  (FROM half) THEN TIME '13:00:00' ELSE TIME '16:00:00' END)) // 1000000 AS close_at, d IN (FROM half) AS early FROM cd WHERE dayofweek(d) BETWEEN 1 AND 5 AND d NOT
  IN (SELECT d FROM shut WHERE d IS NOT NULL))"""
_ORDER_DAYS = "span AS (SELECT min(epoch_us(o_orderdate)) // 86400000000 AS a, max(epoch_us(o_orderdate)) // 86400000000 AS b FROM orders)"


def all_days(rows, day, more=0):
    """Every day from the first to the last of the rows, and `more`."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", F.col("b") + more)).alias("day"))


def order_sessions(spark, sf, more=0):
    return calendar.exchange_sessions(all_days(table(spark, sf, "orders").select(F.floor(epoch("o_orderdate") / 86400).alias("d")), "d", more))


@query("A29_exchange_sessions", f"WITH {_ORDER_DAYS}, {SESSIONS} SELECT day, open_at, close_at, early FROM sessions")
def a29_sessions(spark, sf):
    """The exchange's sessions over the years of the orders: holidays by rule, half days, opening and closing by the local clock."""
    return order_sessions(spark, sf)


@query("B10_trading_day", f"""WITH {_ORDER_DAYS.replace(' AS b', ' + 15 AS b')}, {SESSIONS}, t AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 + o_orderkey % 24 * 3600 +
  1800 AS t FROM orders)
SELECT o_orderkey, min(day) AS trading_day FROM t JOIN sessions ON close_at > t AND close_at < t + 15 * 86400 GROUP BY 1""")
def b10_days(spark, sf):
    """The trading day that each order's time belongs to: the first session that closes after it, across nights, weekends and holidays."""
    s = order_sessions(spark, sf, more=15).select(F.lit(0).alias("line"), "close_at", F.col("day").alias("trading_day"))
    t = stamps(spark, sf).withColumn("line", F.lit(0))
    # times are negated, so that the first close after is the last before; bins are months
    back = s.select("line", (-F.col("close_at")).alias("at"), "trading_day")
    out = windows.asof_backward(t.withColumn("at", -F.col("t") - 1), back, ["line"], "at", "at", ["trading_day"], bin_size=30 * 86_400)
    return out.select("o_orderkey", "trading_day")


@query("E26_stale_session_hours", f"""WITH {BARS}, span AS (SELECT min(hour) // 86400 AS a, max(hour) // 86400 + 1 AS b FROM bars), {SESSIONS},
hs AS (SELECT DISTINCT unnest(generate_series(open_at // 3600 * 3600, (close_at - 1) // 3600 * 3600, 3600)) AS hour FROM sessions),
q AS (SELECT asset, hour // 86400 AS d, max(hour) FILTER (n_src > 1) AS own FROM bars GROUP BY 1, 2),
k AS (SELECT asset, d, (d + 1) * 86400 AS now, max(own) OVER (PARTITION BY asset ORDER BY d) AS newest FROM q)
SELECT asset, d, count(hs.hour) AS stale_hours, count(hs.hour) >= 2 AS alert, count(hs.hour) = 0 AS nothing FROM k LEFT JOIN hs ON hs.hour > newest AND hs.hour < now
WHERE newest IS NOT NULL GROUP BY 1, 2""")
def e26_sessions(spark, sf):
    """At each midnight, the session hours since an instrument's newest full bar (two ticks or more): none means that nothing can have appeared."""
    b = market.bars(spark, sf)
    d = F.floor(F.col("hour") / 86400)
    hours = calendar.session_hours(calendar.exchange_sessions(all_days(b.select(d.alias("d")), "d", 1)))
    newest = F.max(F.when(F.col("n_src") > 1, F.col("hour")))
    k = b.groupBy("asset", d.alias("d")).agg(newest.alias("own"))
    k = k.select("asset", "d", ((F.col("d") + 1) * 86400).alias("now"), F.max("own").over(Window.partitionBy("asset").orderBy("d")).alias("newest"))
    out = calendar.hours_between(k.where("newest is not null"), hours, "newest", "now", "stale_hours")
    return out.select("asset", "d", "stale_hours", (F.col("stale_hours") >= 2).alias("alert"), (F.col("stale_hours") == 0).alias("nothing"))


@query("B3_in_session", f"""WITH {BARS} SELECT asset, hour, (hour // 86400 + 4) % 7 BETWEEN 1 AND 5 AND hour % 86400 < 75600 AND hour % 86400 + 3600 >
  52200 AS in_session FROM bars""")
def b3(spark, sf):
    """Bars that overlap a New York session: a range join by day."""
    b = market.bars(spark, sf)
    days = b.select(F.floor(F.col("hour") / 86400).alias("day")).distinct()
    s = calendar.generate_sessions(days, "America/New_York", "09:30", "16:00").drop("day")
    return quality.overlaps(b, s, []).select("asset", "hour", "in_session")


@query("B4_gate", f"""WITH {BARS} SELECT asset, count(*) AS n, count(*) FILTER (least(open, low) > 0 AND (hour // 86400 + 4) % 7 BETWEEN 1 AND 5 AND
  hour % 86400 < 75600 AND hour % 86400 + 3600 > 52200) AS usable FROM bars GROUP BY 1""")
def b4(spark, sf):
    b = market.bars(spark, sf)
    days = b.select(F.floor(F.col("hour") / 86400).alias("day")).distinct()
    s = calendar.generate_sessions(days, "America/New_York", "09:30", "16:00").drop("day")
    g = quality.overlaps(b, s, []).withColumn("reason", quality.invalid_reason(0.01))
    return g.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("reason") == "") & F.col("in_session")).alias("usable"))


@query("B5_thin_volume", f"""WITH {BARS} SELECT asset, hour, volume <= 0 OR coalesce(volume < 0.5 * CASE WHEN count(CASE WHEN volume > 0 THEN volume
  END) OVER w >= 20 THEN quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5) OVER w END, FALSE) AS thin FROM bars WINDOW w AS (PARTITION BY asset
  ORDER BY hour ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""")
def b5(spark, sf):
    return quality.thin(market.bars(spark, sf), "volume", ["asset"], 100, 20, 0.5).select("asset", "hour", "thin")


@query("B6_opening_misprints", f"""WITH {BARS}, w AS (SELECT asset, hour, open, close, lag(close) OVER x AS pc, lag(hour) OVER x AS ph FROM bars WHERE
  least(open, low) > 0 WINDOW x AS (PARTITION BY asset ORDER BY hour)) SELECT asset, hour FROM w WHERE hour - ph > 3600 AND abs(ln(open / pc)) >= 0.5
  AND abs(ln(close / open)) >= 0.5 AND sign(ln(open / pc)) <> sign(ln(close / open))""")
def b6(spark, sf):
    """First bars after a pause that moved far one way and back."""
    w = Window.partitionBy("asset").orderBy("hour")
    b = market.bars(spark, sf).where(F.least("open", "low") > 0).withColumn("pc", F.lag("close").over(w)).withColumn("ph", F.lag("hour").over(w))
    night, own = F.ln(F.col("open") / F.col("pc")), F.ln(F.col("close") / F.col("open"))
    return (
        b.where((F.col("hour") - F.col("ph") > 3600) & (F.abs(night) >= 0.5) & (F.abs(own) >= 0.5) & (F.signum(night) != F.signum(own)))
        .select("asset", "hour")
    )


@query("B7_priced", f"""WITH {FEED_BARS} SELECT feed, count(*) AS n FROM fbars WHERE isfinite(open) AND isfinite(close) AND open > 0 AND close > 0
  GROUP BY 1""")
def b7(spark, sf):
    ok = lambda c: (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    return market.feed_bars(spark, sf).where(ok("open") & ok("close")).groupBy("feed").agg(F.count(F.lit(1)).alias("n"))


#: Stamps all through the year: an hour of each order's day by its key.
_STAMPS = """s AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 + o_orderkey % 24 * 3600 + 1800 AS t FROM orders),
l AS (SELECT o_orderkey, t, (make_timestamp(t * 1000000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM s)"""


def stamps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (epoch("o_orderdate") + F.col("o_orderkey") % 24 * 3600 + 1800).alias("t"))


@query("B8_regular_session", f"""WITH {_STAMPS} SELECT o_orderkey, isodow(ny) <= 5 AND ny::TIME >= TIME '09:30:00' AND ny::TIME < TIME '16:00:00' AS
  regular FROM l""")
def b8(spark, sf):
    """09:30 to 16:00 by New York's clock, weekdays, summer and winter."""
    return stamps(spark, sf).select("o_orderkey", calendar.regular_session(F.col("t"), 34200, 57600).alias("regular"))


@query("B9_reference_week", f"WITH {_STAMPS} SELECT o_orderkey, dayname(ny - INTERVAL 17 HOUR) NOT IN ('Friday', 'Saturday') AS inside FROM l")
def b9(spark, sf):
    """Sunday 17:00 to Friday 17:00 by New York's clock."""
    return stamps(spark, sf).select("o_orderkey", calendar.reference_week(F.col("t")).alias("inside"))


@query("B10_session_of_hour", f"""WITH {BARS} SELECT asset, hour, (hour + 10800) // 86400 AS session FROM bars WHERE ((hour + 10800) // 86400 + 4) % 7
  BETWEEN 1 AND 5""")
def b10(spark, sf):
    """The trading day of an overnight session (21:00 to 21:00 UTC) by its end."""
    s = F.floor((F.col("hour") + 10800) / 86400)
    return market.bars(spark, sf).select("asset", "hour", s.alias("session")).where(calendar.weekday(F.col("session")).between(1, 5))


@query("B11_previous_trading_day", f"""WITH {BARS}, d AS (SELECT DISTINCT asset, hour // 86400 AS d FROM bars WHERE (hour // 86400 + 4) % 7 BETWEEN 1
  AND 5) SELECT asset, d, lag(d) OVER (PARTITION BY asset ORDER BY d) AS previous FROM d""")
def b11(spark, sf):
    d = market.bars(spark, sf).select("asset", F.floor(F.col("hour") / 86400).alias("d")).distinct().where(calendar.weekday(F.col("d")).between(1, 5))
    return d.withColumn("previous", F.lag("d").over(Window.partitionBy("asset").orderBy("d")))


@query("B12_holiday_closed", """WITH o AS (SELECT o_custkey, o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY
  o_orderdate, o_orderkey) AS p, o_orderkey FROM orders) SELECT o_orderkey, len(list_filter(generate_series(p, d, INTERVAL 1 DAY), lambda x: (month(x)
  = 12 AND day(x) = 25) OR (month(x) = 1 AND day(x) = 1))) > 0 AS holiday FROM o WHERE p IS NOT NULL""")
def b12(spark, sf):
    """Whether the days between a customer's orders touch 25 December or 1 January."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").withColumn("d", d).withColumn("p", F.lag(d).over(w)).where("p is not null")
    touch = F.exists(F.sequence("p", "d"), lambda x: ((F.month(x) == 12) & (F.dayofmonth(x) == 25)) | ((F.month(x) == 1) & (F.dayofmonth(x) == 1)))
    return o.select("o_orderkey", touch.alias("holiday"))


@query("B15_half_open_windows", f"""WITH {TICKS} SELECT count(*) FILTER (t >= 1704672000 AND t < 1705276800) AS inside, count(*) FILTER (t >=
  1705276800) AS behind FROM ticks""")
def b15(spark, sf):
    t = F.col("t")
    return market.ticks(spark, sf).agg(F.count_if((t >= 1704672000) & (t < 1705276800)).alias("inside"), F.count_if(t >= 1705276800).alias("behind"))


@query("B16_nothing_can_have_appeared", f"""WITH {BARS}, n AS (SELECT max(hour) + 7200 AS now FROM bars) SELECT asset, max(hour) + 3600 >= now - 3600
  AS nothing FROM bars, n GROUP BY asset, now""")
def b16(spark, sf):
    """Whether no expected hour lies between the newest stored bar and now."""
    b = market.bars(spark, sf)
    now = b.agg((F.max("hour") + 7200).alias("now"))
    return (
        b.groupBy("asset").agg(F.max("hour").alias("newest")).crossJoin(F.broadcast(now))
        .select("asset", (F.col("newest") + 3600 >= F.col("now") - 3600).alias("nothing"))
    )


@query("B17_own_prefixes", """SELECT doc_id, starts_with(text, 'The ') OR starts_with(text, 'Is ') OR starts_with(text, 'Der ') OR starts_with(text,
  'La ') AS own FROM documents""")
def b17(spark, sf):
    own = F.lit(False)
    for p in ("The ", "Is ", "Der ", "La "):
        own = own | F.startswith(F.col("text"), F.lit(p))
    return table(spark, sf, "documents").select("doc_id", own.alias("own"))


@query("N3_unchanged", f"""WITH {_MERGE} SELECT asset, bool_and(st.close IS NOT DISTINCT FROM m.close OR abs(st.close - m.close) <= 1e-12 + 1e-9 *
  abs(st.close)) AS unchanged FROM (SELECT * FROM merged) m FULL JOIN st USING (asset, hour) GROUP BY 1""")
def n3(spark, sf):
    """Tolerant equality of two versions, null equal to null."""
    store, _, now = merged(spark, sf)
    j = (
        now.select("asset", "hour", F.col("close").alias("b"))
        .join(store.select("asset", "hour", F.col("close").alias("a")), ["asset", "hour"], "full")
    )
    near = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-12 + 1e-9 * F.abs("a"), F.lit(False))
    return j.groupBy("asset").agg(F.bool_and(near).alias("unchanged"))


@query("N6_data_fingerprint", f"""WITH {BARS} SELECT asset, count(*) AS n, sum(('0x' || substr(md5(concat_ws(':', asset, hour::VARCHAR,
  n_src::VARCHAR)), 1, 8))::BIGINT)::BIGINT AS digest FROM bars GROUP BY 1""")
def n6(spark, sf):
    """An order-free digest: the sum of row hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "asset", F.col("hour").cast("string"), F.col("n_src").cast("string"))), 1, 8), 16, 10).cast("long")
    return market.bars(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("digest"))


@query("N9_snapshot_by_source", f"WITH {FEED_BARS} SELECT asset, feed, count(*) AS n FROM fbars GROUP BY 1, 2")
def n9(spark, sf):
    """Each feed's bars as partitions of a snapshot, read back."""
    path = new_path(spark, "snapshot")
    market.feed_bars(spark, sf).write.partitionBy("feed", "asset").parquet(path)
    back = spark.read.schema(T.StructType([*BAR.fields, T.StructField("feed", T.LongType()), T.StructField("asset", T.StringType())])).parquet(path)
    return back.groupBy("asset", "feed").agg(F.count(F.lit(1)).alias("n"))


def contracts(spark, sf):
    """The calendar rows of all contracts whose delivery year is an order's, or one beside it."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    years = years.select(F.explode(F.array(*(F.col("year") + i for i in (-1, 0, 1)))).alias("year")).distinct()
    return calendar.contracts(spark, years)


_WEEKDAYS = f"""spec(ticker, listed, held, ltd_back, ltd_months, ltd_day, ltd_day_back, roll_back, roll_ltd, suffix) AS (VALUES
  {calendar.specs_sql()}),
oy AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), yy AS (SELECT DISTINCT y + unnest([-1, 0, 1]) AS y FROM oy),
wd AS (SELECT d::DATE AS d, row_number() OVER (ORDER BY d) AS n FROM (SELECT unnest(generate_series((SELECT make_date(min(y)::INT - 1, 1, 1) FROM yy),
  (SELECT make_date(max(y)::INT + 2, 1, 1) FROM yy), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5),
c AS (SELECT spec.*, y, instr('FGHJKMNQUVXZ', code) AS m, code FROM spec, yy, (SELECT unnest(string_split('FGHJKMNQUVXZ', '')) AS code) WHERE
  contains(listed, code)),
b AS (SELECT *, CASE WHEN ltd_day IS NOT NULL THEN make_date(y::INT, m::INT, ltd_day::INT) ELSE (make_date(y::INT, m::INT, 1) + to_months((1 -
  ltd_months)::INT))::DATE END AS bound, CASE WHEN ltd_day IS NOT NULL THEN ltd_day_back - 1 ELSE ltd_back END AS back FROM c),
l AS (SELECT b.*, w.d AS ltd, w.n AS ltd_n FROM b JOIN wd w ON w.n = (SELECT max(n) FROM wd WHERE wd.d < b.bound) - b.back),
h AS (SELECT l.*, CASE WHEN roll_ltd IS NOT NULL THEN ltd_n - roll_ltd ELSE (SELECT min(n) FROM wd WHERE wd.d >= make_date(l.y::INT, l.m::INT, 1)) -
  roll_back - 1 END AS end_n FROM l WHERE contains(held, code)),
f AS (SELECT ticker, replace(ticker, '=F', '') || code || lpad((y % 100)::VARCHAR, 2, '0') || '.' || suffix AS contract, lag(end_n) OVER (PARTITION BY
  ticker ORDER BY y, m) + 1 AS first_n FROM h),
roll AS (SELECT ticker, contract, wd.d AS first_day FROM f JOIN wd ON wd.n = f.first_n)"""


@query("G_last_trading_days", f"WITH {_WEEKDAYS} SELECT ticker, y::INT AS year, m::INT AS month, ltd::VARCHAR AS last_day FROM l")
def g_last(spark, sf):
    """Each listed contract's last trading day, by the exchange's rule on weekdays."""
    return contracts(spark, sf).select("ticker", "year", "month", F.col("last_day").cast("string"))


@query("G_roll_days", f"WITH {_WEEKDAYS} SELECT ticker, contract, first_day::VARCHAR AS first_day FROM roll")
def g_rolls(spark, sf):
    """Each held contract and the first day on which it is in front: the weekday after the one before it is left."""
    return calendar.rolls(contracts(spark, sf)).select("ticker", "contract", F.col("first_day").cast("string"))


@query("G_roll_sessions", f"""WITH {_WEEKDAYS}, e AS (SELECT ticker, (ltd + 1)::DATE AS edge FROM l UNION SELECT ticker, first_day FROM roll),
s AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate) <= 5),
j AS (SELECT ticker, edge, d, row_number() OVER (PARTITION BY ticker, edge ORDER BY d) AS n FROM e JOIN s ON d >= edge - 1) SELECT DISTINCT ticker,
  d::VARCHAR AS session FROM j WHERE n <= 2 AND d <= edge + 7""")
def g_roll_sessions(spark, sf):
    """The first two sessions from the day before each last trading day's morrow or roll on, within a week: their opening gaps may hold a roll."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("session")).where(F.dayofweek("o_orderdate").between(2, 6)).distinct()
    return calendar.roll_sessions(contracts(spark, sf), days).select("ticker", F.col("session").cast("string"))


@query("G_front_contract", f"""WITH {_WEEKDAYS}, t AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS k FROM spec),
o AS (SELECT o_orderkey, o_orderdate::DATE AS d, ticker FROM orders JOIN t ON t.k = o_custkey % (SELECT count(*) FROM spec))
SELECT o_orderkey, o.ticker, contract, first_day::VARCHAR AS since FROM o ASOF LEFT JOIN roll ON o.ticker = roll.ticker AND o.d >= roll.first_day""")
def g_front(spark, sf):
    """The contract in force on each order's day, for an instrument by the customer: an as-of lookup over the rolls, cut into months."""
    names = F.array(*(F.lit(t) for t in sorted(x[0] for x in calendar.SPECS)))
    o = (
        table(spark, sf, "orders")
        .select(
            "o_orderkey", F.get(names, (F.col("o_custkey") % len(calendar.SPECS)).cast("int")).alias("ticker"),
            F.floor(epoch("o_orderdate") / 86400).alias("d"),
        )
    )
    rolls = (
        calendar.rolls(contracts(spark, sf))
        .select("ticker", F.unix_date("first_day").cast("long").alias("at"), "contract", F.col("first_day").cast("string").alias("since"))
    )
    return (
        windows.asof_backward(o, rolls, ["ticker"], "d", "at", ["contract", "since"], bin_size=30).select("o_orderkey", "ticker", "contract", "since")
    )


@query("G_business_days", """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 86400000000 AS d FROM orders) SELECT o_orderkey,
  list_filter(list_transform(generate_series(1, 10), lambda k: d - k), lambda x: (x + 4) % 7 BETWEEN 1 AND 5)[3] AS third_before FROM o""")
def g_business(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(epoch("o_orderdate") / 86400).alias("d"))
    return o.select("o_orderkey", calendar.business_days_back(F.col("d"), 3).alias("third_before"))


__all__ = ["load", "vote"]
