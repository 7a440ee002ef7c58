"""Scalar families and the rendering of messages over grouped rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import brackets, scalars
from ..operators import windows
from ..registry import query
from ..sources import market
from ..sources.staging import stage
from .common import BARS, SCORED, r6
from .detector import scored

table, epoch = market.table, market.epoch


@query("G_math", f"""WITH {BARS} SELECT asset, hour, round(ln(close / open), 6) AS a, round(log10(1 + close), 6) AS b, round(exp(-close / 100), 6) AS
  c, round(sqrt(high - low), 6) AS d, sign(close - open)::DOUBLE AS e, ceil(close)::BIGINT AS f, floor(open)::BIGINT AS g FROM bars WHERE least(open,
  close) > 0""")
def g_math(spark, sf):
    b = market.bars(spark, sf).where(F.least("open", "close") > 0)
    return b.select(
        "asset", "hour", r6(F.ln(F.col("close") / F.col("open")), "a"), r6(F.log10(1 + F.col("close")), "b"), r6(F.exp(-F.col("close") / 100), "c"),
        r6(F.sqrt(F.col("high") - F.col("low")), "d"), F.signum(F.col("close") - F.col("open")).alias("e"), F.ceil("close").alias("f"),
        F.floor("open").alias("g"),
    )


@query("G_is_close", f"""WITH {BARS}, p AS (SELECT asset, hour, close AS a, lag(close) OVER (PARTITION BY asset ORDER BY hour) AS b FROM bars) SELECT
  asset, count(*) FILTER ((a IS NULL AND b IS NULL) OR coalesce(abs(a - b) <= 0.1 + 0.05 * abs(b), FALSE)) AS n_close FROM p GROUP BY 1""")
def g_is_close(spark, sf):
    p = market.bars(spark, sf).withColumn("b", F.lag("close").over(Window.partitionBy("asset").orderBy("hour")))
    return p.groupBy("asset").agg(F.count_if(scalars.is_close(F.col("close"), F.col("b"), 0.05, 0.1)).alias("n_close"))


@query("G_dates", """SELECT o_orderkey, dayofweek(o_orderdate)::BIGINT AS weekday, isoyear(o_orderdate)::BIGINT AS iso_year, week(o_orderdate)::BIGINT
  AS iso_week, last_day(o_orderdate)::VARCHAR AS month_end, strftime(o_orderdate, '%d.%m.%Y') AS local FROM orders""")
def g_dates(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", (F.dayofweek(d) - 1).cast("long").alias("weekday"), F.expr("""extract(YEAROFWEEK FROM
  to_date(o_orderdate))""").cast("long").alias("iso_year"), F.weekofyear(d).cast("long").alias("iso_week"), F.last_day(d).cast("string").alias("month_end"), F.date_format(d, "dd.MM.yyyy").alias("local"))


@query("G_strings", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS
  slug, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, concat_ws('|', lang, source) AS tags,
  split_part(text, chr(10), 1) = text AS one_line FROM documents""")
def g_strings(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", scalars.slug("text").alias("slug"), scalars.html_escape("text").alias("escaped"),
        F.concat_ws("|", "lang", "source").alias("tags"), (F.split_part("text", F.lit("\n"), F.lit(1)) == F.col("text")).alias("one_line"),
    )


@query("G_strings_whole", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
  replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""")
def g_strings_whole(spark, sf):
    """The slug and the escaping of whole texts."""
    return (
        table(spark, sf, "documents").select("doc_id", scalars.slug(F.col("text")).alias("slug"), scalars.html_escape(F.col("text")).alias("escaped"))
    )


@query("G_urls", r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS
  page FROM pages""")
def g_urls(spark, sf):
    return (
        table(spark, sf, "pages")
        .select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))
    )


@query("G_balanced_blocks", """SELECT page_id, url, length(html) AS n, '{margin:0}' AS style FROM pages WHERE html IS NOT NULL AND url IS NOT NULL AND contains(html,
  '<style>p{margin:0}</style>')""")
def g_balanced(spark, sf):
    """Each page with its own record as JSON in a script: the record found by its brackets, quotes and escapes masked, and read; and the page's style."""
    p = table(spark, sf, "pages").where("html is not null and url is not null")
    record = F.to_json(F.struct("page_id", "url", F.struct(F.col("html").alias("{text}")).alias("in")))
    whole = F.concat("html", F.lit("<script>RECORD ="), record, F.lit(";</script>}}\"{"))
    read = brackets.balanced(p.select(whole.alias("text")), "text", {"records": "<script>RECORD", "styles": "<style>p"})
    read = read.select(F.col("styles")[0].alias("style"), F.from_json(
        F.col("records")[0], "page_id long, url string, in struct<`{text}`: string>", {"maxStringLen": "2147483647"}).alias("r"))  # pages of over 20 million characters too
    return read.where("style is not null").select("r.page_id", "r.url", F.char_length(F.col("r.in")["{text}"]).cast("long").alias("n"), "style")


@query("G_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS a, substr(sha1(text), 1, 12) AS b, md5(text) AS c FROM documents")
def g_hashes(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("a"), F.substring(F.sha1("text"), 1, 12).alias("b"), F.md5("text").alias("c"))
    )


@query("G_arrays", """WITH g AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS l, list(l_quantity ORDER BY l_linenumber) AS q
  FROM lineitem GROUP BY 1) SELECT k, len(l)::BIGINT AS n, list_contains(l, 3) AS has_three, list_sum(list_transform(q, lambda x: x * 2))::DOUBLE AS
  twice, len(list_filter(q, lambda x: x > 25))::BIGINT AS large, array_to_string(l, ',') AS joined FROM g""")
def g_arrays(spark, sf):
    g = (
        table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    )
    l, q = F.col("x.l_linenumber"), F.col("x.l_quantity")
    return g.select(
        "k", F.size("x").cast("long").alias("n"), F.array_contains(l, 3).alias("has_three"),
        F.aggregate(F.transform(q, lambda v: v * 2), F.lit(0.0), lambda s, v: s + v).alias("twice"),
        F.size(F.filter(q, lambda v: v > 25)).cast("long").alias("large"),
        F.array_join(F.transform(l, lambda v: v.cast("string")), ",").alias("joined"),
    )


@query("G_json", r"""SELECT event_id, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k, concat('{', chr(34), 'id', chr(34), ':', event_id, ',',
  chr(34), 'type', chr(34), ':', chr(34), event_type, chr(34), '}') AS doc FROM events""")
def g_json(spark, sf):
    return (
        table(spark, sf, "events")
        .select(
            "event_id", F.from_json("props", "k long").getField("k").alias("k"),
            F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"),
        )
    )


@query(
    "G_html_extract",
    r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n_text FROM pages",
)
def g_html(spark, sf):
    """Fields of raw pages by patterns, and the length without tags."""
    return (
        table(spark, sf, "pages")
        .select(
            "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
            F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"),
        )
    )


@query("G_recode", """SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
  ELSE 'Low' END AS impact, count(*) AS n FROM orders GROUP BY 1, 2""")
def g_recode(spark, sf):
    impact = scalars.recode(F.col("o_orderpriority"), {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium"}, F.lit("Low"))
    return table(spark, sf, "orders").groupBy("o_orderpriority", impact.alias("impact")).agg(F.count(F.lit(1)).alias("n"))


@query("G_clean", f"""WITH {BARS} SELECT asset, hour, CASE WHEN n_src > 2 THEN close END AS close, try_cast(concat(n_src, CASE WHEN n_src > 4 THEN 'x'
  ELSE '' END) AS BIGINT) AS n FROM bars""")
def g_clean(spark, sf):
    """NaN as null, text that is no number as null."""
    b = market.bars(spark, sf).withColumn("close", F.when(F.col("n_src") > 2, F.col("close")).otherwise(float("nan")))
    text = F.concat(F.col("n_src").cast("string"), F.when(F.col("n_src") > 4, "x").otherwise(""))
    return b.select("asset", "hour", F.when(~F.isnan("close"), F.col("close")).alias("close"), text.try_cast("bigint").alias("n"))


_SPAN = """CASE WHEN s >= 86400 THEN (s // 86400)::BIGINT || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END WHEN s >= 3600 THEN (s //
  3600)::BIGINT || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END ELSE (s // 60)::BIGINT || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE
  's' END END"""


_K2 = f"""{SCORED}, words AS (SELECT asset, hour, z, word, hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour) AS s FROM scored WHERE word IS NOT
  NULL),
lines AS (SELECT asset, hour, concat(asset, ' ', CASE WHEN z > 0 THEN 'up' ELSE 'down' END, ': ', word, coalesce(', first in ' || {_SPAN}, '')) AS
  line FROM words)"""


@query("K2_describe", f"WITH {_K2} SELECT asset, hour, line FROM lines")
def k2(spark, sf):
    s = scored(spark, sf).where("word is not null")
    gap = F.col("hour") - F.lag("hour").over(Window.partitionBy("asset").orderBy("hour"))
    line = F.concat(
        "asset", F.lit(" "), F.when(F.col("z") > 0, "up").otherwise("down"), F.lit(": "), "word",
        F.coalesce(F.concat(F.lit(", first in "), scalars.span_text(F.col("gap"))), F.lit("")),
    )
    return s.withColumn("gap", gap).select("asset", "hour", line.alias("line"))


@query("K3_message", f"""WITH {SCORED} SELECT hour // 86400 AS d, string_agg(asset || ' ' || word, '; ' ORDER BY abs(z) DESC, asset, hour) AS message,
  count(*) AS n FROM scored WHERE word IN ('rare', 'extreme') GROUP BY 1""")
def k3(spark, sf):
    """A day's message, largest moves first."""
    s = scored(spark, sf).where("word in ('rare', 'extreme')").withColumn("d", F.floor(F.col("hour") / 86400))
    rows = F.array_sort(F.collect_list(F.struct((-F.abs("z")).alias("size"), "asset", "hour", F.concat_ws(" ", "asset", "word").alias("text"))))
    return s.groupBy("d").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "; ").alias("message"), F.count(F.lit(1)).alias("n"))


@query("K4_digest_pages", f"""WITH RECURSIVE {_K2}, b AS (SELECT hour // 86400 AS d, sum(length(line) + 1)::BIGINT AS size, count(*) AS n_lines, (hour
  // 86400 + 3) // 7 AS week FROM lines GROUP BY 1, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY d) AS i FROM b),
e(week, i, d, size, n_lines, page, used) AS (
  SELECT DISTINCT week, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM k
  UNION ALL
  SELECT k.week, k.i, k.d, k.size, k.n_lines, e.page + CASE WHEN e.used > 0 AND e.used + k.size > 400 THEN 1 ELSE 0 END, CASE WHEN e.used > 0 AND
  e.used + k.size > 400 THEN k.size ELSE e.used + k.size END
  FROM e JOIN k ON k.week = e.week AND k.i = e.i + 1)
SELECT d, size, n_lines, week, page FROM e WHERE i > 0""")
def k4(spark, sf):
    """A week's lines in pages of 400 characters that keep a day's block whole: an ordered fold within the week."""
    lines = k2(spark, sf).withColumn("d", F.floor(F.col("hour") / 86400))
    blocks = (
        lines.groupBy("d").agg(F.sum(F.length("line") + 1).alias("size"), F.count(F.lit(1)).alias("n_lines"))
        .withColumn("week", F.floor((F.col("d") + 3) / 7))
    )
    return windows.folded(blocks, ["week"], "d", ["size"], page_step(400), lambda: (0, 0), "page bigint")


def page_step(budget: int):
    """A page holds blocks up to the budget; a block is never split. State: page, characters on it."""

    def step(state, size):
        page, used = state
        page, used = (page + 1, size) if used and used + size > budget else (page, used + size)
        return (page, used), (page,)

    return step


@query("K5_coming_week", f"""WITH {BARS}, x AS (SELECT (min(hour) // 86400 + 3) // 7 * 7 + 4 AS monday FROM bars) SELECT hour // 86400 AS d, count(*)
  AS n, string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets FROM bars, x WHERE hour // 86400 >= monday AND hour // 86400 < monday + 7 GROUP BY 1""")
def k5(spark, sf):
    """The rows of the week that begins next Monday, by day."""
    b = market.bars(spark, sf)
    x = b.agg((F.floor((F.floor(F.min("hour") / 86400) + 3) / 7) * 7 + 4).alias("monday"))
    d = F.floor(F.col("hour") / 86400)
    j = b.crossJoin(F.broadcast(x)).withColumn("d", d).where("d >= monday and d < monday + 7")
    return j.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("asset")), ",").alias("assets"))


@query("K6_calendar_context", f"""WITH {SCORED}, ev AS (SELECT asset, hour FROM scored WHERE word IN ('rare', 'extreme')), rel AS (SELECT event_id,
  epoch_us(ts) // 1000000 AS t FROM events WHERE event_id % 100 = 0) SELECT asset, hour, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY
  event_id) AS releases FROM ev JOIN rel ON t BETWEEN hour - 7200 AND hour + 3600 GROUP BY 1, 2""")
def k6(spark, sf):
    """Releases within two hours before to one after a large move, by hour bins."""
    ev = scored(spark, sf).where("word in ('rare', 'extreme')").select("asset", "hour")
    ev = ev.withColumn("bin", F.explode(F.sequence(F.floor(F.col("hour") / 3600) - 2, F.floor(F.col("hour") / 3600) + 1)))
    rel = market.ticks(spark, sf).where("event_id % 100 = 0").select("event_id", "t", F.floor(F.col("t") / 3600).alias("bin"))
    j = ev.join(rel, "bin").where("t between hour - 7200 and hour + 3600")
    return (
        j.groupBy("asset", "hour")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda v: v.cast("string")), ",").alias("releases"),
        )
    )


@query("K7_report_lines", f"""WITH {BARS} SELECT asset, concat('| ', asset, ' | ', count(*), ' | ', min(hour), ' | ', max(hour), ' |') AS line FROM
  bars GROUP BY 1""")
def k7(spark, sf):
    g = market.bars(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    return g.select(
        "asset",
        F.concat(
            F.lit("| "), F.concat_ws(" | ", "asset", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), F.lit(" |"),
        ).alias("line"),
    )


@query("H3_watermark_settled", f"""WITH {BARS} SELECT asset, hour // 86400 AS d, (hour // 86400 + 1) * 86400 + 86400 <= (SELECT max(hour) FROM bars)
  AS settled, count(*) AS n FROM bars GROUP BY 1, 2, 3""")
def h3(spark, sf):
    b = market.bars(spark, sf)
    top = b.agg(F.max("hour").alias("top"))
    d = F.floor(F.col("hour") / 86400)
    return (
        b.crossJoin(F.broadcast(top)).groupBy("asset", d.alias("d"), ((d + 1) * 86400 + 86400 <= F.col("top")).alias("settled"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("H7_known_by", f"WITH {BARS} SELECT asset, count(*) FILTER (hour + 3600 <= 1705500000) AS known, count(*) AS n FROM bars GROUP BY 1")
def h7(spark, sf):
    return market.bars(spark, sf).groupBy("asset").agg(F.count_if(F.col("hour") + 3600 <= 1705500000).alias("known"), F.count(F.lit(1)).alias("n"))


@query("H11_week_slots", f"""WITH {BARS}, c AS (SELECT (hour // 86400 + 3) // 7 AS wk, max(hour) + 3900 AS turn FROM bars WHERE hour % 86400 <= 72000
  AND (hour // 86400 + 4) % 7 BETWEEN 1 AND 5 GROUP BY 1) SELECT b.asset, b.hour, max(c.turn) AS slot FROM bars b LEFT JOIN c ON c.turn <= b.hour
  GROUP BY 1, 2""")
def h11(spark, sf):
    """The weekly slot of an hour: the last week's end (its last close and five minutes) at or before it; an as-of lookup week by week."""
    b = market.bars(spark, sf).select("asset", "hour")
    week = (F.pmod(F.floor(F.col("hour") / 86400) + 4, F.lit(7))).between(1, 5) & (F.col("hour") % 86400 <= 72000)
    turns = b.where(week).groupBy(F.floor((F.floor(F.col("hour") / 86400) + 3) / 7).alias("wk")).agg((F.max("hour") + 3900).alias("slot"))
    turns = turns.select("slot", F.col("slot").alias("turn"))
    return windows.asof_backward(b, turns, [], "hour", "turn", ["slot"], bin_size=7 * 86400).select("asset", "hour", "slot")


@query("H12_idempotent_delivery", f"""WITH {SCORED}, was AS (SELECT asset, hour, word, hour // 3600 % 10 = 0 AS unsure FROM scored WHERE abs(z) >=
  1.5),
now AS (SELECT asset, hour, CASE WHEN abs(z) >= 3.1 THEN 'extreme' WHEN abs(z) >= 2.5 THEN 'rare' WHEN abs(z) >= 2.0 THEN 'large' ELSE 'notable' END
  AS word FROM scored WHERE abs(z) >= 1.4)
SELECT now.asset, CASE WHEN was.hour IS NULL THEN 'send' WHEN was.word <> now.word THEN 'edit' WHEN unsure THEN 'adopt' ELSE 'skip' END AS action,
  count(*) AS n FROM now LEFT JOIN was ON was.asset = now.asset AND was.hour = now.hour GROUP BY 1, 2""")
def h12(spark, sf):
    """A second delivery, after the words' thresholds moved, set against the ledger of the first: readings that the ledger lacks are sent, those whose
    fingerprint differs are edited, sends that never were confirmed (hours divisible by ten) are adopted, the others are left alone."""
    z = F.abs("z")
    reading = F.concat_ws(":", "asset", F.col("hour").cast("string"))
    printed = lambda df: df.select("asset", reading.alias("id"), F.sha1(F.concat_ws(":", reading, "word")).alias("print"), "hour")
    s = scored(spark, sf)
    ledger = stage(
        printed(s.where("word is not null")).select("id", F.col("print").alias("sent"), (F.floor(F.col("hour") / 3600) % 10 == 0).alias("unsure")),
        "ledger",
    )
    again = F.when(z >= 3.1, "extreme").when(z >= 2.5, "rare").when(z >= 2.0, "large").when(z >= 1.4, "notable")
    now = printed(s.withColumn("word", again).where("word is not null")).join(ledger, "id", "left")
    action = F.when(F.col("sent").isNull(), "send").when(F.col("sent") != F.col("print"), "edit").when(F.col("unsure"), "adopt").otherwise("skip")
    return now.groupBy("asset", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("H13_missed_runs", f"""WITH {BARS}, g AS (SELECT asset, hour, (hour - lag(hour) OVER (PARTITION BY asset ORDER BY hour)) // 3600 - 1 AS missed
  FROM bars) SELECT asset, hour, missed, missed % 2 = 0 AS remind FROM g WHERE missed >= 1""")
def h13(spark, sf):
    missed = F.floor((F.col("hour") - F.lag("hour").over(Window.partitionBy("asset").orderBy("hour"))) / 3600) - 1
    return market.bars(spark, sf).select("asset", "hour", missed.alias("missed")).where("missed >= 1").withColumn("remind", F.col("missed") % 2 == 0)


@query("H14_retention", f"""WITH {SCORED} SELECT asset, count(*) FILTER (word IN ('rare', 'extreme') OR hour >= (SELECT max(hour) FROM bars) - 10 *
  86400) AS kept, count(*) AS n FROM scored WHERE word IS NOT NULL GROUP BY 1""")
def h14(spark, sf):
    s = scored(spark, sf).where("word is not null")
    top = market.bars(spark, sf).agg(F.max("hour").alias("top"))
    keep = F.col("word").isin("rare", "extreme") | (F.col("hour") >= F.col("top") - 10 * 86400)
    return s.crossJoin(F.broadcast(top)).groupBy("asset").agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("H15_calendar_extension", f"""WITH {BARS}, o AS (SELECT DISTINCT asset, hour // 86400 AS d, 16 AS c FROM bars WHERE hour // 86400 < 19740), n
  AS (SELECT DISTINCT asset, hour // 86400 AS d, CASE WHEN hour // 86400 % 10 = 0 THEN 13 ELSE 16 END AS c FROM bars WHERE hour // 86400 >= 19728), g
  AS (SELECT o.asset, count(*) AS overlap, avg((o.c <> n.c)::INT) AS differ FROM o JOIN n USING (asset, d) GROUP BY 1) SELECT n.asset, n.d,
  n.c::BIGINT AS closes FROM n JOIN g USING (asset) WHERE overlap >= 10 AND differ <= 0.5 AND NOT EXISTS (SELECT 1 FROM o WHERE o.asset = n.asset AND
  o.d = n.d)""")
def h15(spark, sf):
    """New calendar days are appended only where enough of the overlap agrees."""
    d = market.bars(spark, sf).select("asset", F.floor(F.col("hour") / 86400).alias("d")).distinct()
    o = d.where("d < 19740").withColumn("a", F.lit(16))
    n = d.where("d >= 19728").withColumn("closes", F.when(F.col("d") % 10 == 0, 13).otherwise(16).cast("long"))
    ok = (
        o.join(n, ["asset", "d"]).groupBy("asset").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("a") != F.col("closes")).cast("int")).alias("x"))
        .where("k >= 10 and x <= 0.5")
    )
    return n.join(o, ["asset", "d"], "left_anti").join(ok, "asset", "left_semi").select("asset", "d", "closes")
