"""The daily volatility index: yardsticks, thresholds, spikes, as-known ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import volatility, windows
from ..registry import query
from ..sources import market
from .common import r6

DAILY = """idx AS (SELECT epoch_us(o_orderdate) // 1000000 AS day, (sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*)) AS close FROM orders GROUP BY
  1),
ret AS (SELECT day, close, day + 86400 + 54000 AS available_at, ln(close / lag(close) OVER (ORDER BY day)) AS r FROM idx)"""


def returns(spark, sf):
    d = market.daily_index(spark, sf).withColumn("series", F.lit("index"))
    return d.withColumn("r", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("series").orderBy("day"))))


@query("D3_available_first", """WITH a AS (SELECT epoch_us(o_orderdate) // 1000000 AS day, o_orderpriority AS src,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS close FROM orders GROUP BY 1, 2)
SELECT day, arg_min(close, src) AS close, min(day + 54000 + 3600 * substr(src, 1, 1)::BIGINT) AS available_at FROM a GROUP BY 1""")
def d3(spark, sf):
    """Several sources of one day: the first source's value, the earliest time any was known."""
    o = (
        market.table(spark, sf, "orders")
        .select(
            market.epoch("o_orderdate").alias("day"), F.col("o_orderpriority").alias("src"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"),
        )
    )
    a = o.groupBy("day", "src").agg(F.sum("p").cast("double").alias("close"))
    return (
        a.groupBy("day")
        .agg(
            F.min_by("close", "src").alias("close"), F.min(F.col("day") + 54000 + 3600 * F.substring("src", 1, 1).cast("long")).alias("available_at"),
        )
    )


_EW = "list_sum(list_transform(range(1, len({l}) + 1), lambda i: {l}[i] * pow(0.94::DOUBLE, len({l}) - i)))"


@query("E18_long_run_sigma", f"""WITH {DAILY}, w AS (SELECT day, list(r * r) FILTER (r IS NOT NULL) OVER (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1
  PRECEDING) AS l FROM ret)
SELECT day, round(CASE WHEN len(l) >= 20 THEN sqrt({_EW.format(l='l')} / list_sum(list_transform(range(1, len(l) + 1), lambda i: pow(0.94::DOUBLE,
  len(l) - i)))) END, 6) AS sigma_lt FROM w""")
def e18(spark, sf):
    return volatility.long_run_sigma(returns(spark, sf), ["series"], "day", "r", 60, 0.94, 20).select("day", r6("sigma_lt"))


@query("E19_ewma_state", f"""WITH RECURSIVE {DAILY}, k AS (SELECT day, r, row_number() OVER (ORDER BY day) AS i FROM ret WHERE r IS NOT NULL),
e(i, day, m, v, z, sd) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
  UNION ALL
  SELECT i, day, 0.94::DOUBLE * m + 0.06::DOUBLE * x, 0.94::DOUBLE * v + 0.06::DOUBLE * (x - m) * (x - m), z, sd
  FROM (SELECT *, CASE WHEN z IS NULL THEN r ELSE m + greatest(-5.0::DOUBLE, least(5.0::DOUBLE, z)) * sd END AS x
    FROM (SELECT k.i, k.day, k.r, e.m, e.v, sqrt(e.v) AS sd, CASE WHEN k.i > 20 AND e.v > 0 THEN (k.r - e.m) / sqrt(e.v) END AS z FROM e JOIN k ON k.i
  = e.i + 1)))
SELECT day, round(z, 6) AS z, round(sd, 6) AS sd FROM e WHERE i > 0""")
def e19(spark, sf):
    """Sequential z with winsorised updates: a fold in the order of days."""
    d = returns(spark, sf).where("r is not null").select("series", "day", "r")
    return (
        windows.folded(d, ["series"], "day", ["r"], volatility.ewma_step, volatility.ewma_start, "z double, sd double")
        .select("day", r6("z"), r6("sd"))
    )


@query("E20_rolling_quantiles", f"""WITH {DAILY}, w AS (SELECT day, abs(r) AS a FROM ret WHERE r IS NOT NULL)
SELECT day, round(CASE WHEN count(a) OVER x >= 20 THEN quantile_cont(a, 0.95) OVER x END, 6) AS q95, round(CASE WHEN count(a) OVER x >= 20 THEN
  quantile_cont(a, 0.99) OVER x END, 6) AS q99 FROM w WINDOW x AS (ORDER BY day ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)""")
def e20(spark, sf):
    d = returns(spark, sf).where("r is not null").withColumn("a", F.abs("r"))
    return volatility.trailing_quantiles(d, ["series"], "day", "a", 120, 20).select("day", r6("q95"), r6("q99"))


@query("E21_rolling_mad", f"""WITH {DAILY}, w AS (SELECT day, list(r) OVER (ORDER BY day ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l FROM ret)
SELECT day, round(CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) = 24 THEN list_median(list_transform(l, lambda x: abs(x - list_median(l))))
  END, 6) AS mad FROM w""")
def e21(spark, sf):
    return volatility.rolling_mad(returns(spark, sf), ["series"], "day", "r", 24).select("day", r6("mad"))


@query("E22_spikes", f"""WITH {DAILY}, w AS (SELECT day, r, list(r) OVER (ORDER BY day ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l, list(r * r)
  FILTER (r IS NOT NULL) OVER (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS s,
  CASE WHEN count(r) OVER x >= 20 THEN quantile_cont(abs(r), 0.95) OVER x END AS q95 FROM ret WINDOW x AS (ORDER BY day ROWS BETWEEN 120 PRECEDING AND
  1 PRECEDING)),
v AS (SELECT day, r, q95, CASE WHEN len(s) >= 20 THEN sqrt({_EW.format(l='s')} / list_sum(list_transform(range(1, len(s) + 1), lambda i:
  pow(0.94::DOUBLE, len(s) - i)))) END AS sig FROM w)
SELECT day, coalesce(abs(r) > q95 AND r > 0 AND abs(r) >= 1.5 * sig, FALSE) AS is_spike FROM v""")
def e22(spark, sf):
    """A rise beyond the trailing 95th percentile and 1.5 long-run sigmas; a fall never is one."""
    d = volatility.long_run_sigma(returns(spark, sf), ["series"], "day", "r", 60, 0.94, 20).withColumn("a", F.abs("r"))
    d = volatility.trailing_quantiles(d, ["series"], "day", "a", 120, 20)
    return d.select(
        "day", F.coalesce((F.col("a") > F.col("q95")) & (F.col("r") > 0) & (F.col("a") >= 1.5 * F.col("sigma_lt")), F.lit(False)).alias("is_spike"),
    )


#: Scores of daily returns against a winsorised short memory, and thresholds of |z| over 60 days, by recursion over the days.
_SMOOTHED = f"""{DAILY}, w0 AS (SELECT day, r, list(r) OVER (ORDER BY day ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l, list(r * r)
  FILTER (r IS NOT NULL) OVER (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS s FROM ret),
w1 AS (SELECT day, r, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) = 24 THEN list_median(list_transform(l, lambda x: abs(x - list_median(l)))) END AS mad,
  CASE WHEN len(s) >= 20 THEN sqrt({_EW.format(l='s')} / list_sum(list_transform(range(1, len(s) + 1), lambda i: pow(0.94::DOUBLE, len(s) - i)))) END AS sig FROM w0),
w2 AS (SELECT *, CASE WHEN mad IS NOT NULL AND sig IS NOT NULL AND abs(r) > 5 * greatest(mad, 0.2::DOUBLE * sig) THEN sign(r) * 5 * greatest(mad, 0.2::DOUBLE * sig) ELSE r
  END AS rw FROM w1),
w3 AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM w2 WHERE r IS NOT NULL),
st(i, day, r, sig, m, v, z, sd) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, (SELECT r * r FROM w3 WHERE i = 1), NULL::DOUBLE, NULL::DOUBLE
  UNION ALL
  SELECT k.i, k.day, k.r, k.sig, 0.08::DOUBLE * k.rw + 0.92::DOUBLE * m, 0.08::DOUBLE * (k.rw - m) * (k.rw - m) + 0.92::DOUBLE * v,
    CASE WHEN k.sig IS NOT NULL THEN (k.r - m) / greatest(sqrt(v), 0.2::DOUBLE * k.sig) END, greatest(sqrt(v), coalesce(0.2::DOUBLE * k.sig, 0))
  FROM st JOIN w3 k ON k.i = st.i + 1),
zs AS (SELECT day, r, sig, z, row_number() OVER (ORDER BY day) AS j, CASE WHEN count(z) OVER x >= 60 THEN quantile_cont(abs(z), 0.95) OVER x END AS q95,
  CASE WHEN count(z) OVER x >= 60 THEN quantile_cont(abs(z), 0.99) OVER x END AS q99 FROM st WHERE z IS NOT NULL
  WINDOW x AS (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
sm(j, day, q95, q99) AS (
  SELECT j, day, q95, q99 FROM zs WHERE j = 61
  UNION ALL
  SELECT z.j, z.day, z.q95 * 2 / 121.0::DOUBLE + sm.q95 * 119 / 121.0::DOUBLE, z.q99 * 2 / 121.0::DOUBLE + sm.q99 * 119 / 121.0::DOUBLE FROM sm JOIN zs z ON z.j = sm.j + 1)"""


def index_scores(spark, sf):
    d = volatility.long_run_sigma(returns(spark, sf), ["series"], "day", "r", 60, 0.94, 20)
    return volatility.ewma_scores(d, ["series"], "day")


@query("E19_winsorised_state", f"WITH RECURSIVE {_SMOOTHED} SELECT day, round(z, 6) AS z, round(sd, 6) AS sigma_eff FROM st WHERE i > 0")
def e19_winsorised(spark, sf):
    """Scores before the state's update; what the state learns is winsorised, and its deviation has a floor."""
    return index_scores(spark, sf).where("r is not null").select("day", r6("z"), r6("sigma_eff"))


@query("E20_smoothed_thresholds", f"""WITH RECURSIVE {_SMOOTHED} SELECT zs.day, round(sm.q95, 6) AS q95, round(sm.q99, 6) AS q99 FROM zs LEFT JOIN sm USING
  (day)""")
def e20_smoothed(spark, sf):
    out = volatility.smoothed_thresholds(index_scores(spark, sf), ["series"], "day", "z", 60)
    return out.select("day", r6("q95"), r6("q99"))


@query("E22_winsorised_spikes", f"""WITH RECURSIVE {_SMOOTHED} SELECT zs.day, coalesce(z > sm.q95 AND r > 0 AND abs(r) >= 1.5 * sig, FALSE) AS is_spike FROM zs LEFT
  JOIN sm USING (day)""")
def e22_winsorised(spark, sf):
    """A rise beyond the smoothed threshold of its own score and 1.5 long-run sigmas."""
    out = volatility.smoothed_thresholds(index_scores(spark, sf), ["series"], "day", "z", 60)
    spike = (F.col("z") > F.col("q95")) & (F.col("r") > 0) & (F.abs("r") >= 1.5 * F.col("sigma_lt"))
    return out.select("day", F.coalesce(spike, F.lit(False)).alias("is_spike"))


@query("E23_known_rank", f"""WITH {DAILY} SELECT a.day, round(avg((b.close <= a.close)::INT), 6) AS rank_known, count(*) AS n_known FROM ret a JOIN
  ret b ON b.available_at <= a.day GROUP BY 1""")
def e23(spark, sf):
    """Share of the values known on a day that are not above it: counted by blocks of ranks, not by pairs of days."""
    d = returns(spark, sf).select("series", "day", "close", "available_at")
    known = d.select("series", F.col("available_at").alias("day"), "close")
    least = (
        windows.earlier_at_least(d, ["series"], "day", -F.col("close"), -F.col("close"), [], points=known, upto=True)
        .withColumnRenamed("_n", "n_upto").drop("_last")
    )
    all_ = (
        windows.earlier_at_least(d, ["series"], "day", F.lit(0.0), F.lit(0.0), [], points=known, upto=True)
        .select("day", F.col("_n").alias("n_known"))
    )
    return least.join(all_, "day").where("n_known > 0").select("day", r6(F.col("n_upto") / F.col("n_known"), "rank_known"), "n_known")


@query("C8_asof_backward", f"""WITH {DAILY}, e AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS t FROM orders) SELECT o_orderkey, t,
  ret.close AS known_close, ret.day AS known_day FROM e ASOF LEFT JOIN ret ON e.t >= ret.available_at""")
def c8(spark, sf):
    """Each order with the index value known at its time."""
    e = market.table(spark, sf, "orders").select("o_orderkey", market.epoch("o_orderdate").alias("t"), F.lit("index").alias("series"))
    d = returns(spark, sf).select("series", "available_at", F.col("close").alias("known_close"), F.col("day").alias("known_day"))
    # one series: its time line is cut into months, and the last value is carried into each
    return (
        windows.asof_backward(e, d, ["series"], "t", "available_at", ["known_close", "known_day"], bin_size=30 * market.DAY)
        .select("o_orderkey", "t", "known_close", "known_day")
    )


@query("C9_asof_forward", """WITH l AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), n AS (SELECT event_type, t FROM l
  WHERE event_id % 10 = 0) SELECT event_id, l.t, min(n.t) AS next_t FROM l LEFT JOIN n ON l.event_type = n.event_type AND n.t > l.t GROUP BY 1, 2""")
def c9(spark, sf):
    """The first marked tick of the instrument strictly after each tick."""
    t = market.ticks(spark, sf).select("asset", "event_id", "t")
    n = t.where("event_id % 10 = 0").select("asset", F.col("t").alias("next_t"))
    return windows.asof_forward(t, n, ["asset"], "t", "next_t", ["next_t"]).select("event_id", "t", "next_t")


@query("C13_full_compare", f"""WITH {DAILY}, o AS (SELECT day, close FROM ret WHERE day % (7 * 86400) <> 0), n AS (SELECT day, CASE WHEN day % (5 *
  86400) = 0 THEN close + 1 ELSE close END AS close FROM ret)
SELECT count(*) FILTER (o.day IS NULL) AS only_new, count(*) FILTER (n.day IS NULL) AS only_old, count(*) FILTER (abs(o.close - n.close) > 1e-9) AS
  changed FROM o FULL JOIN n USING (day)""")
def c13(spark, sf):
    d = returns(spark, sf)
    o = d.where(F.col("day") % (7 * 86400) != 0).select("day", F.col("close").alias("a"), F.lit(1).alias("o"))
    n = d.select("day", F.when(F.col("day") % (5 * 86400) == 0, F.col("close") + 1).otherwise(F.col("close")).alias("b"), F.lit(1).alias("n"))
    return (
        o.join(n, "day", "full")
        .agg(
            F.count_if(F.col("o").isNull()).alias("only_new"), F.count_if(F.col("n").isNull()).alias("only_old"),
            F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("changed"),
        )
    )


@query("D10_publication_lag", f"WITH {DAILY} SELECT median(available_at - day)::DOUBLE AS median_lag, count(*) AS n FROM ret")
def d10(spark, sf):
    return returns(spark, sf).agg(F.expr("percentile(available_at - day, 0.5)").alias("median_lag"), F.count(F.lit(1)).alias("n"))


@query("E24_spike_live_hours", f"""WITH {DAILY}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS n, coalesce(r > 0.2, FALSE) AS spike FROM ret)
SELECT day, max(CASE WHEN spike THEN n END) OVER (ORDER BY day) >= n - 2 AS live FROM s""")
def e24(spark, sf):
    """A spike stays live for three rows of the reference calendar, counted in its rows and not in clock time."""
    w = Window.partitionBy("series").orderBy("day")
    s = returns(spark, sf).withColumn("n", F.row_number().over(w)).withColumn("spike", F.coalesce(F.col("r") > 0.2, F.lit(False)))
    return s.select("day", (F.max(F.when(F.col("spike"), F.col("n"))).over(w) >= F.col("n") - 2).alias("live"))


@query("J1_derive_actions", f"""WITH p AS (SELECT l_partkey AS ticker, epoch_us(l_shipdate) // 1000000 AS day, arg_min(l_extendedprice, (l_orderkey,
  l_linenumber)) AS close, max(CASE WHEN l_discount >= 0.09 THEN l_discount * 100 ELSE 0 END) AS div_cash, max(CASE WHEN l_tax >= 0.08 THEN 2.0 ELSE
  1.0 END) AS split FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS pc FROM p WHERE close > 0)
SELECT ticker, day, 'dividend' AS kind, round((div_cash / pc) / (1 - div_cash / pc), 6) AS step FROM q WHERE (div_cash / pc) / (1 - div_cash / pc) >=
  1e-5
UNION ALL SELECT ticker, day, 'split', round(split::DOUBLE - 1, 6) FROM q WHERE abs(split - 1) >= 1e-5""")
def j1(spark, sf):
    """Payout steps d / (1 - d) over the previous close, and splits, from daily rows."""
    li = market.table(spark, sf, "lineitem")
    p = li.groupBy(F.col("l_partkey").alias("ticker"), market.epoch("l_shipdate").alias("day")).agg(
        F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber")).alias("close"), F.max(F.when(
            F.col("l_discount") >= 0.09, F.col("l_discount") * 100,
        ).otherwise(0.0)).alias("div_cash"), F.max(F.when(F.col("l_tax") >= 0.08, 2.0).otherwise(1.0)).alias("split"))
    q = p.where("close > 0").withColumn("pc", F.lag("close").over(Window.partitionBy("ticker").orderBy("day")))
    d = F.col("div_cash") / F.col("pc")
    pay = q.select("ticker", "day", F.lit("dividend").alias("kind"), (d / (1 - d)).alias("step")).where("step >= 1e-5")
    cut = q.where("abs(split - 1) >= 1e-5").select("ticker", "day", F.lit("split").alias("kind"), (F.col("split") - 1).alias("step"))
    return pay.unionByName(cut).withColumn("step", F.round("step", 6))


@query("J2_adjusted_ratio_steps", """WITH p AS (SELECT o_custkey AS ticker, o_orderkey AS day, o_totalprice AS raw, o_totalprice * CASE WHEN
  o_orderpriority = '1-URGENT' THEN 0.5 ELSE 1.0 END AS adj FROM orders),
q AS (SELECT *, (adj / raw) / lag(adj / raw) OVER (PARTITION BY ticker ORDER BY day) - 1 AS step FROM p) SELECT ticker, day, round(step, 6) AS step,
  abs(step) >= 0.2 AS is_split FROM q WHERE abs(step) >= 1e-5""")
def j2(spark, sf):
    p = (
        market.table(spark, sf, "orders")
        .select(
            F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("day"),
            (F.col("o_totalprice") * F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).otherwise(1.0) / F.col("o_totalprice")).alias("ratio"),
        )
    )
    step = F.col("ratio") / F.lag("ratio").over(Window.partitionBy("ticker").orderBy("day")) - 1
    return p.withColumn("step", step).where("abs(step) >= 1e-5").select("ticker", "day", r6("step"), (F.abs("step") >= 0.2).alias("is_split"))


@query("J3_payouts_from_amounts", """WITH pay AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000000 AS ex, l_tax * 100 AS
  amount FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0),
px AS (SELECT l_partkey, epoch_us(l_shipdate) // 1000000 AS day, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, ex, round(amount / (px.close - amount), 6) AS step FROM pay ASOF LEFT JOIN px ON pay.l_partkey = px.l_partkey AND
  pay.ex > px.day""")
def j3(spark, sf):
    """A payout over the last close before its ex date."""
    li = (
        market.table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", market.epoch("l_shipdate").alias("ex"), "l_tax", "l_returnflag", "l_extendedprice")
    )
    pay = (
        li.where("l_returnflag = 'R' and l_tax > 0")
        .select("l_orderkey", "l_linenumber", "l_partkey", "ex", (F.col("l_tax") * 100).alias("amount"), (F.col("ex") - 1).alias("upto"))
    )
    px = li.groupBy("l_partkey", F.col("ex").alias("day")).agg(F.max("l_extendedprice").alias("close"))
    out = windows.asof_backward(pay, px, ["l_partkey"], "upto", "day", ["close"])
    return out.select("l_orderkey", "l_linenumber", "ex", r6(F.col("amount") / (F.col("close") - F.col("amount")), "step"))


@query("J4_merge_actions", """WITH o AS (SELECT l_partkey AS ticker, l_orderkey AS day, max(l_tax) AS step FROM lineitem WHERE l_returnflag = 'A'
  GROUP BY 1, 2), n AS (SELECT l_partkey AS ticker, l_orderkey AS day, max(l_discount) AS step FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT ticker, day, step, FALSE AS added FROM o UNION ALL SELECT ticker, day, step, TRUE FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ticker =
  n.ticker AND o.day = n.day)""")
def j4(spark, sf):
    """Known actions stay; only unseen keys are added."""
    li = market.table(spark, sf, "lineitem")
    of = lambda flag, x: li.where(F.col("l_returnflag") == flag).groupBy(
        F.col("l_partkey").alias("ticker"), F.col("l_orderkey").alias("day"),
    ).agg(F.max(x).alias("step"))
    o, n = of("A", "l_tax"), of("R", "l_discount")
    return o.withColumn("added", F.lit(False)).unionByName(n.join(o, ["ticker", "day"], "left_anti").withColumn("added", F.lit(True)))


@query("J5_tables_running_out", """WITH t AS (SELECT l_suppkey AS ticker, max(epoch_us(l_shipdate) // 1000000) AS checked FROM lineitem WHERE
  l_returnflag <> 'N' GROUP BY 1)
SELECT ticker, checked, checked < (SELECT max(checked) FROM t) - 30 * 86400 AS running_out FROM t""")
def j5(spark, sf):
    """Payout tables whose last checked day lies 30 days or more behind the newest."""
    t = (
        table(spark, sf).where("l_returnflag <> 'N'").groupBy(F.col("l_suppkey").alias("ticker"))
        .agg(F.max(market.epoch("l_shipdate")).alias("checked"))
    )
    top = t.agg((F.max("checked") - 30 * 86400).alias("line"))
    return t.crossJoin(F.broadcast(top)).select("ticker", "checked", (F.col("checked") < F.col("line")).alias("running_out"))


def table(spark, sf):
    return market.table(spark, sf, "lineitem")
