"""Joins, sets, sorts, limits, and aggregations over orders and line items: quotas, profiles, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import basket
from ..operators.bars import islands
from ..operators.quantiles import exact_quantiles
from ..registry import query
from ..sources import market
from .common import BARS, FEED_BARS, r6

table, epoch = market.table, market.epoch


def usage(spark, sf):
    """day, provider, purpose, calls: line items shipped as calls to providers."""
    li = table(spark, sf, "lineitem")
    return li.select(
        epoch("l_shipdate").alias("day"), F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("purpose"),
        F.col("l_quantity").cast("long").alias("calls"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


USAGE = """usage AS (SELECT epoch_us(l_shipdate) // 1000000 AS day, l_returnflag AS provider, l_linestatus AS purpose, l_quantity::BIGINT AS calls,
  l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


@query("D5_usage_rows", f"""WITH {USAGE} SELECT day, provider, purpose, sum(calls)::BIGINT AS calls, arg_max(calls, seq) AS left_last FROM usage GROUP
  BY 1, 2, 3""")
def d5(spark, sf):
    return usage(spark, sf).groupBy("day", "provider", "purpose").agg(F.sum("calls").alias("calls"), F.max_by("calls", "seq").alias("left_last"))


@query("D6_quota_left", f"""WITH {USAGE}, d AS (SELECT provider, day, sum(calls) AS c FROM usage GROUP BY 1, 2), m AS (SELECT provider, day // (30 *
  86400) AS mon, sum(calls) AS c FROM usage GROUP BY 1, 2)
SELECT d.provider, d.day, least(greatest(0, 200 - d.c), greatest(0, 4000 - m.c))::BIGINT AS votes_left FROM d JOIN m ON d.provider = m.provider AND
  d.day // (30 * 86400) = m.mon""")
def d6(spark, sf):
    """The least of what a day's and a month's shares have left."""
    u = usage(spark, sf)
    d = u.groupBy("provider", "day", F.floor(F.col("day") / (30 * 86400)).alias("mon")).agg(F.sum("calls").alias("d"))
    m = d.groupBy("provider", "mon").agg(F.sum("d").alias("m"))
    return (
        d.join(m, ["provider", "mon"])
        .select(
            "provider", "day",
            F.least(F.greatest(F.lit(0), 200 - F.col("d")), F.greatest(F.lit(0), 4000 - F.col("m"))).cast("long").alias("votes_left"),
        )
    )


@query("D6_threshold_crossings", f"""WITH {USAGE}, d AS (SELECT provider, day, sum(calls) AS c FROM usage GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER
  (PARTITION BY provider, day // (365 * 86400) ORDER BY day) AS upto FROM d)
SELECT provider, day, upto::BIGINT AS upto FROM r WHERE upto - c < 20000 AND upto >= 20000""")
def d6b(spark, sf):
    """Days at which a provider's year passes a line: was below, is at or above."""
    d = usage(spark, sf).groupBy("provider", "day").agg(F.sum("calls").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("provider", F.floor(F.col("day") / (365 * 86400))).orderBy("day"))
    return d.withColumn("upto", upto).where("upto - c < 20000 and upto >= 20000").select("provider", "day", "upto")


@query("D7_limits_pivot", f"""WITH {USAGE} SELECT provider, day // (30 * 86400) AS mon, coalesce(sum(calls) FILTER (purpose = 'F'), 0)::BIGINT AS f,
  coalesce(sum(calls) FILTER (purpose = 'O'), 0)::BIGINT AS o FROM usage GROUP BY 1, 2""")
def d7(spark, sf):
    u = usage(spark, sf).withColumn("mon", F.floor(F.col("day") / (30 * 86400)))
    p = u.groupBy("provider", "mon").pivot("purpose", ["F", "O"]).sum("calls")
    zero = F.lit(0).cast("long")
    return p.select("provider", "mon", F.coalesce("F", zero).alias("f"), F.coalesce("O", zero).alias("o"))


@query("D8_profile", f"""WITH {BARS}, x AS (SELECT *, hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour) AS gap FROM bars), m AS (SELECT asset,
  median(n_src) AS m FROM bars GROUP BY 1), pd AS (SELECT asset, median(n)::DOUBLE AS md FROM (SELECT asset, hour // 86400, count(*) AS n FROM bars
  GROUP BY 1, 2) GROUP BY 1)
SELECT asset, count(*) AS n, min(hour) AS first, max(hour) AS last, count(DISTINCT hour // 86400) AS n_days, any_value(md) AS median_per_day, max(gap)
  AS max_gap, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (n_src < m) AS partial_hours,
  count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive, count(*) FILTER (low > least(open, close) OR greatest(open, close) > high) AS
  inconsistent FROM x JOIN m USING (asset) JOIN pd USING (asset) GROUP BY 1""")
def d8(spark, sf):
    """One row an instrument; medians are group-bys of their own, joined to the bars as a row an instrument."""
    b = market.bars(spark, sf)
    per_day = (
        b.groupBy("asset", F.floor(F.col("hour") / 86400).alias("d")).agg(F.count(F.lit(1)).alias("k")).groupBy("asset")
        .agg(F.percentile("k", 0.5).alias("md"))
    )
    median = b.groupBy("asset").agg(F.percentile("n_src", 0.5).alias("m"))
    gap = F.col("hour") - F.lag("hour").over(Window.partitionBy("asset").orderBy("hour"))
    x = b.withColumn("gap", gap).join(median, "asset").join(per_day, "asset")
    return x.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("hour").alias("first"), F.max("hour").alias("last"), F.count_distinct(F.floor(F.col("hour") / 86400)).alias("n_days"),
        F.any_value("md").alias("median_per_day"), F.max("gap").alias("max_gap"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.count_if(F.col("n_src") < F.col("m")).alias("partial_hours"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("nonpositive"),
        F.count_if((F.col("low") > F.least("open", "close")) | (F.greatest("open", "close") > F.col("high"))).alias("inconsistent"),
    )


@query("D9_precision", f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY hour DESC) AS n FROM bars) SELECT asset,
  max(length(split_part(rtrim(printf('%.6f', close), '0'), '.', 2)))::BIGINT AS decimals FROM t WHERE n <= 500 GROUP BY 1""")
def d9(spark, sf):
    """Decimals in use in the last 500 closes of each instrument."""
    from ..operators.windows import last_rows

    text = F.regexp_replace(F.format_string("%.6f", "close"), "0+$", "")
    return (
        last_rows(market.bars(spark, sf), ["asset"], "hour", 500).groupBy("asset")
        .agg(F.max(F.length(F.split_part(text, F.lit("."), F.lit(2)))).cast("long").alias("decimals"))
    )


@query("D11_issue_notes", f"""WITH {BARS}, p AS (SELECT asset, count(*) FILTER (least(open, high, low, close) <= 0) AS bad, count(*) FILTER (n_src =
  1) AS thin, 720 - count(*) AS missing FROM bars GROUP BY 1) SELECT asset, concat_ws(', ', CASE WHEN bad > 0 THEN bad || ' without a price' END, CASE
  WHEN thin > 100 THEN thin || ' of one tick' END, CASE WHEN missing > 0 THEN missing || ' hours missing' END) AS notes FROM p""")
def d11(spark, sf):
    p = (
        market.bars(spark, sf).groupBy("asset")
        .agg(
            F.count_if(F.least("open", "high", "low", "close") <= 0).alias("bad"), F.count_if(F.col("n_src") == 1).alias("thin"),
            (F.lit(720) - F.count(F.lit(1))).alias("missing"),
        )
    )
    note = lambda c, n, text: F.when(F.col(c) > n, F.concat(F.col(c).cast("string"), F.lit(text)))
    return p.select(
        "asset",
        F.concat_ws(", ", note("bad", 0, " without a price"), note("thin", 100, " of one tick"), note("missing", 0, " hours missing")).alias("notes"),
    )


@query("D17_busiest_week", """WITH o AS (SELECT o_orderpriority AS block, epoch_us(o_orderdate) // 86400000000 AS d FROM orders), w AS (SELECT block,
  (d - 2) // 7 AS wk, count(*) AS n FROM o GROUP BY 1, 2)
SELECT block, count(*) AS n_weeks, sum(n)::BIGINT AS total, max(n) AS busiest, arg_max(wk, n * 100000 - wk) AS busiest_week FROM w GROUP BY 1""")
def d17(spark, sf):
    """Rows by week ending on Friday, and the busiest week."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("block"), F.floor(epoch("o_orderdate") / 86400).alias("d"))
    w = o.groupBy("block", F.floor((F.col("d") - 2) / 7).alias("wk")).agg(F.count(F.lit(1)).alias("n"))
    return (
        w.groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("n_weeks"), F.sum("n").alias("total"), F.max("n").alias("busiest"),
            F.max_by("wk", F.col("n") * 100000 - F.col("wk")).alias("busiest_week"),
        )
    )


@query("D18_archive_years", """WITH c AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1), y AS
  (SELECT o_custkey, unnest(generate_series(a, b)) AS y FROM c), n AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT y.y::BIGINT AS year, count(*) AS customers, any_value(n.n) AS orders FROM y JOIN n USING (y) GROUP BY 1""")
def d18(spark, sf):
    """Series alive in each calendar year, and rows of it."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    alive = (
        o.groupBy("o_custkey").agg(F.min("y").alias("a"), F.max("y").alias("b")).select(F.explode(F.sequence("a", "b")).alias("y")).groupBy("y")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return alive.join(o.groupBy("y").agg(F.count(F.lit(1)).alias("orders")), "y").select(F.col("y").cast("long").alias("year"), "customers", "orders")


@query("D19_biggest_rows", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.999) AS q FROM lineitem GROUP BY 1) SELECT
  l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS top FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice >= q GROUP BY
  1, 2""")
def d19(spark, sf):
    """Rows at or above their group's 99.9th percentile, which is found by selection: a group may hold a third of all rows."""
    li = table(spark, sf, "lineitem")
    q = exact_quantiles(li, ["l_returnflag"], F.col("l_extendedprice"), [0.999]).select("l_returnflag", F.col("q0").alias("q"))
    return (
        li.join(q, "l_returnflag").where("l_extendedprice >= q").groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top"))
    )


@query("D20_cross_footing", """WITH d AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2)) AS qty FROM lineitem GROUP
  BY 1, 2)
SELECT l_returnflag, l_linestatus, n, qty::DOUBLE AS qty, TRUE AS foots FROM d
UNION ALL SELECT l_returnflag, NULL, sum(n)::BIGINT, sum(qty)::DOUBLE, sum(n) = any_value(direct) FROM d JOIN (SELECT l_returnflag AS f, count(*) AS
  direct FROM lineitem GROUP BY 1) ON f = l_returnflag GROUP BY 1
UNION ALL SELECT NULL, NULL, sum(n)::BIGINT, sum(qty)::DOUBLE, sum(n) = (SELECT count(*) FROM lineitem) FROM d""")
def d20(spark, sf):
    """Counts by two keys with their subtotals and total, and whether each subtotal is the sum of the rows below it."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    level = F.grouping_id().alias("level")
    t = li.rollup("l_returnflag", "l_linestatus").agg(level, F.count(F.lit(1)).alias("n"), F.sum("q").alias("qty"))
    below = t.where("level = 0").groupBy("l_returnflag").agg(F.sum("n").alias("sum_n"), F.sum("qty").alias("sum_qty"))
    sums = below.select("l_returnflag", F.lit(1).alias("level"), "sum_n", "sum_qty")
    sums = sums.unionByName(below.agg(F.sum("sum_n").alias("sum_n"), F.sum("sum_qty").alias("sum_qty")).select(
        F.lit(None).cast("string").alias("l_returnflag"), F.lit(3).alias("level"), "sum_n", "sum_qty",
    ))
    sums = sums.select(F.col("l_returnflag").alias("of"), F.col("level").alias("at"), "sum_n", "sum_qty")
    j = t.join(sums, (t["level"] == sums["at"]) & t["l_returnflag"].eqNullSafe(sums["of"]), "left")
    foots = F.when(F.col("level") == 0, True).otherwise(F.coalesce((F.col("n") == F.col("sum_n")) & (F.col("qty") == F.col("sum_qty")), F.lit(False)))
    return j.select("l_returnflag", "l_linestatus", "n", F.col("qty").cast("double").alias("qty"), foots.alias("foots"))


@query("D20_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def d20b(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("D21_rates_by_block", """WITH c AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey =
  c_custkey GROUP BY 1, 2)
SELECT c_mktsegment AS block, round(quantile_cont(n, 0.1), 6) AS q10, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.9), 6) AS q90,
  count(*) FILTER (n = 0) AS none FROM c GROUP BY 1""")
def d21(spark, sf):
    """Rate a series with zeros for silent ones; median, 10th and 90th percentiles by block."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer")
    x = c.join(n, c.c_custkey == n.o_custkey, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q = lambda p: F.percentile("n", p)
    return (
        x.groupBy(F.col("c_mktsegment").alias("block"))
        .agg(r6(q(0.1), "q10"), r6(q(0.5), "q50"), r6(q(0.9), "q90"), F.count_if(F.col("n") == 0).alias("none"))
    )


@query("D23_count_distinct", """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT epoch_us(ts) // 86400000000) AS days FROM events
  GROUP BY 1""")
def d23(spark, sf):
    return (
        table(spark, sf, "events").groupBy("event_type")
        .agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.floor(epoch("ts") / 86400)).alias("days"))
    )


@query("C1_inner_join", """SELECT n_name, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey =
  c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def c1(spark, sf):
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("C2_bid_ask_mid", f"""WITH {FEED_BARS} SELECT a.asset, a.hour, round((a.close + b.close) / 2, 6) AS mid FROM fbars a JOIN fbars b ON a.asset =
  b.asset AND a.hour = b.hour WHERE a.feed = 0 AND b.feed = 1 AND a.volume > 0 AND b.volume > 0""")
def c2(spark, sf):
    """Two sides of a quote joined by their stamp; hours without volume left out."""
    f = market.feed_bars(spark, sf).where("volume > 0")
    side = lambda n, name: f.where(F.col("feed") == n).select("asset", "hour", F.col("close").alias(name))
    return side(0, "bid").join(side(1, "ask"), ["asset", "hour"]).select("asset", "hour", r6((F.col("bid") + F.col("ask")) / 2, "mid"))


@query("C3_left_enrich", """SELECT p_partkey, p_brand, coalesce(n, 0) AS n, last_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n,
  max(epoch_us(l_shipdate) // 1000000) AS last_ship FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def c3(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max(epoch("l_shipdate")).alias("last_ship"))
    p = table(spark, sf, "part")
    return (
        p.join(li, p.p_partkey == li.l_partkey, "left").select("p_partkey", "p_brand", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "last_ship")
    )


@query("C4_dim_lookup", """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON
  n_regionkey = r_regionkey""")
def c4(spark, sf):
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    dim = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    return s.join(F.broadcast(dim), s.s_nationkey == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("C5_group_map_back", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS
  share FROM lineitem""")
def c5(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice") / F.sum("l_extendedprice").over(w), "share"))


@query("C6_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def c6(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("C7_anti_join", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority =
  '1-URGENT')""")
def c7(spark, sf):
    """Customers without an urgent order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("C10_range_join", """WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), w AS (SELECT event_type, t - 7200 AS a,
  t + 3600 AS b, event_id AS wid FROM e WHERE event_id % 50 = 0) SELECT wid, count(*) AS n FROM w JOIN e ON e.event_type = w.event_type AND e.t
  BETWEEN a AND b GROUP BY 1""")
def c10(spark, sf):
    """Rows within [t - 2 h, t + 1 h] of marked ones: equi-join on the instrument and the hour bins that a window touches."""
    e = market.ticks(spark, sf).select("event_id", "asset", "t").withColumn("bin", F.floor(F.col("t") / 3600))
    w = e.where("event_id % 50 = 0").select("asset", F.col("event_id").alias("wid"), (F.col("t") - 7200).alias("a"), (F.col("t") + 3600).alias("b"))
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("b") / 3600))))
    return w.join(e, ["asset", "bin"]).where("t between a and b").groupBy("wid").agg(F.count(F.lit(1)).alias("n"))


@query("F1_sorted_output", """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM
  orders QUALIFY place <= 100""")
def f1(spark, sf):
    """The first hundred by two keys: a top-k report."""
    o = table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(100)
    return o.select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"),
        F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"),
    )


@query("F2_top_k_per_group", """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY
  l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""")
def f2(spark, sf):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return (
        table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 3")
        .select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    )


@query("F3_tail_per_key", f"WITH {BARS} SELECT asset, hour, close FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY hour DESC) <= 48")
def f3(spark, sf):
    from ..operators.windows import last_rows

    return last_rows(market.bars(spark, sf), ["asset"], "hour", 48).select("asset", "hour", "close")


@query("F4_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey LIMIT 50")
def f4(spark, sf):
    """A sample that repeats: the first fifty by a hash of key and seed."""
    return (
        table(spark, sf, "customer").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":7"))), "c_custkey").limit(50)
        .select("c_custkey")
    )


@query("F5_union_keep_last", f"""WITH {FEED_BARS}, u AS (SELECT asset, hour, close, feed FROM fbars) SELECT asset, hour, close, feed FROM u QUALIFY
  row_number() OVER (PARTITION BY asset, hour ORDER BY feed DESC) = 1""")
def f5(spark, sf):
    from ..operators.bars import keep_last

    f = market.feed_bars(spark, sf).select("asset", "hour", "close", "feed")
    parts = [f.where(F.col("feed") == n) for n in range(market.FEEDS)]
    return keep_last(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["asset", "hour"], F.desc("feed"))


@query("F6_union_distinct", "SELECT o_orderdate::DATE::VARCHAR AS day FROM orders UNION SELECT l_shipdate::DATE::VARCHAR FROM lineitem")
def f6(spark, sf):
    d = lambda t, c: table(spark, sf, t).select(F.to_date(c).cast("string").alias("day"))
    return d("orders", "o_orderdate").union(d("lineitem", "l_shipdate")).distinct()


@query("F7_set_operations", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k
  FROM lineitem WHERE l_returnflag = 'R')
SELECT 'difference' AS op, count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a
  INTERSECT SELECT k FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT
  SELECT k FROM a))""")
def f7(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")).distinct() for x in ("A", "R"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return (
        n(a.subtract(b), "difference").unionByName(n(a.intersect(b), "intersection")).unionByName(n(a.subtract(b).union(b.subtract(a)), "symmetric"))
    )


@query("F8_added_keys", """SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem p
  WHERE p.l_linestatus = 'F' AND p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey)""")
def f8(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus")
    return (
        li.where("l_linestatus = 'O'").join(li.where("l_linestatus = 'F'"), ["l_partkey", "l_suppkey"], "left_anti").select("l_partkey", "l_suppkey")
        .distinct()
    )


@query("E27_missing_hours", f"""WITH {BARS}, s AS (SELECT asset, unnest(generate_series(min(hour), max(hour), 3600)) AS hour FROM bars GROUP BY 1),
  miss AS (SELECT asset, hour FROM s ANTI JOIN bars USING (asset, hour)),
g AS (SELECT *, sum(CASE WHEN hour - p > 7200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY hour) AS run FROM (SELECT *, lag(hour)
  OVER (PARTITION BY asset ORDER BY hour) AS p FROM miss))
SELECT asset, min(hour) AS first, max(hour) AS last, count(*) AS n FROM g GROUP BY asset, run""")
def e27(spark, sf):
    """Hours that the calendar has and the store lacks, as runs."""
    from ..operators.bars import expected_hours

    b = market.bars(spark, sf).select("asset", "hour")
    return islands(expected_hours(b, ["asset"], "hour", 3600).join(b, ["asset", "hour"], "left_anti"), ["asset"], "hour", 7200)


@query("E26_stale_hours", f"""WITH {BARS}, x AS (SELECT max(hour) + 3600 AS now FROM bars) SELECT asset, ((now - max(hour)) // 3600 - 1)::BIGINT AS
  stale_hours, (now - max(hour)) // 3600 - 1 >= 2 AS alert FROM bars, x GROUP BY asset, now""")
def e26(spark, sf):
    b = market.bars(spark, sf)
    now = b.agg((F.max("hour") + 3600).alias("now"))
    s = b.groupBy("asset").agg(F.max("hour").alias("newest")).crossJoin(F.broadcast(now))
    stale = (F.floor((F.col("now") - F.col("newest")) / 3600) - 1).cast("long")
    return s.select("asset", stale.alias("stale_hours"), (stale >= 2).alias("alert"))


@query("E28_max_gap", f"""WITH {BARS} SELECT asset, max(gap) AS max_gap FROM (SELECT asset, hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour)
  AS gap FROM bars) GROUP BY 1""")
def e28(spark, sf):
    gap = F.col("hour") - F.lag("hour").over(Window.partitionBy("asset").orderBy("hour"))
    return market.bars(spark, sf).select("asset", gap.alias("gap")).groupBy("asset").agg(F.max("gap").alias("max_gap"))


@query("D4_daily_fold", f"""WITH {BARS} SELECT asset, hour // 86400 AS d, round(sum(ln(close / open)), 6) AS move, max(hour) AS last_hour,
  bool_or(n_src > 3) AS busy FROM bars WHERE least(open, close) > 0 GROUP BY 1, 2""")
def d4(spark, sf):
    b = market.bars(spark, sf).where(F.least("open", "close") > 0)
    return (
        b.groupBy("asset", F.floor(F.col("hour") / 86400).alias("d"))
        .agg(r6(F.sum(F.ln(F.col("close") / F.col("open"))), "move"), F.max("hour").alias("last_hour"), F.bool_or(F.col("n_src") > 3).alias("busy"))
    )


_BASKET = """config AS (SELECT 'T' || (c_custkey - CASE WHEN c_custkey % 40 = 1 THEN 1 ELSE 0 END) AS ticker, ['feed', 'book', 'desk'][(c_custkey // 2
  % 3 + 1)::INT] AS source,
  c_mktsegment || ' ' || c_nationkey % 40 AS block, n_name AS template, CASE WHEN c_custkey % 31 <> 0 THEN c_acctbal / 1000 END AS tick FROM customer
  JOIN nation ON n_nationkey = c_nationkey),
told AS (SELECT n_name AS template FROM nation WHERE n_regionkey <> 3)"""


@query("A19_basket", f"""WITH {_BASKET} SELECT ticker, source, block, template, tick, CASE WHEN tick IS NULL THEN 'a field is missing' WHEN source =
  'desk' THEN 'unknown source' WHEN tick <= 0 THEN 'tick not above zero'
  WHEN count(*) OVER (PARTITION BY source, ticker) > 1 THEN 'listed twice' WHEN template NOT IN (SELECT template FROM told) THEN
  'template not described' WHEN count(*) OVER (PARTITION BY block) < 2 THEN 'block too small' ELSE '' END AS problem FROM config""")
def a19(spark, sf):
    """The instrument dimension checked row by row: customers as instruments of their segment's and nation's block."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, ("feed", "book", "desk"))), (F.floor(key / 2) % 3 + 1).cast("int"))
    config = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("T"), (key - (key % 40 == 1).cast("long")).cast("string")).alias("ticker"), source.alias("source"),
        F.concat_ws(
            " ", "c_mktsegment", (F.col("c_nationkey") % 40).cast("string"),
        ).alias("block"), F.col("n_name").alias("template"), F.when(key % 31 != 0, F.col("c_acctbal") / 1000).alias("tick"),
    )
    return basket.problems(config, n.where("n_regionkey <> 3").select(F.col("n_name").alias("template")), ["feed", "book"])
