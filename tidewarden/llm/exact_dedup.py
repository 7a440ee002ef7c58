"""Exact de-duplication with a heavy-hitter split, in DataFrame operations only.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] is replaced by one space; the digest
is the SHA-256 of that. A frequent-items sketch of the Misra-Gries family (merged in two levels) names
the digests that may hold over HEAVY_SHARE of the rows; exact counts verify them, and the verified winners,
1 / HEAVY_SHARE at most, are broadcast, so rows of a heavy group meet no shuffle. All other digests are
grouped by an ordinary shuffle with map-side combining, and only groups of two or more are joined back.

Defined cases: null text counts as empty; of rows with equal text the smallest doc_id stays, null doc_ids
last, and of rows that also repeat the doc_id one stays; an empty table gives an empty result; other columns,
whatever their names, are ignored by `exact_groups` and carried through by `drop_copies`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Share of all rows above which a digest counts as heavy; the sketch's error, 3.5 / SKETCH_ITEMS, is below it.
HEAVY_SHARE = 1 / 1000
SKETCH_ITEMS = 8192
#: Groups of map partitions whose sketches are merged first.
SKETCH_GROUPS = 128

_RUN = r"[\x20\x09-\x0D]+"


def text_digest(text="text"):
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUN, " "), 256)


def heavy_digests(keyed: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """digest, keep, group_size of the digests in more than `share` of the rows, exactly counted."""
    sketch = (
        keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(digest, {SKETCH_ITEMS})").alias("sketch"))
        .groupBy(F.lit("all").alias("all"))  # grouped, so that tasks without rows make no sketch
        .agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"))
    )
    top = int(1 / share)
    candidates = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {top})")).alias("x")).select("x.item")
    names = [r.item for r in candidates.collect()]  # `top` names at most
    named = keyed.sparkSession.createDataFrame([(n,) for n in names], "digest string")
    counted = keyed.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(*_aggregates())
    rows = F.lit(share * keyed.count())
    return counted.where(F.col("group_size") > rows)


def _aggregates():
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    return first.alias("keep"), F.count(F.lit(1)).alias("group_size")


def exact_groups(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = c.stage(docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), F.monotonically_increasing_id().alias("rid")), "digests")
    heavy = c.stage(heavy_digests(keyed, share), "heavy")  # at most 1 / share rows
    marked = keyed.join(F.broadcast(heavy), "digest", "left")
    light = marked.where(F.col("keep").isNull()).select("digest", "doc_id", "rid")
    several = light.groupBy("digest").agg(*_aggregates()).where(F.col("group_size") > 1)
    light = light.join(several, "digest", "left")
    both = light.unionByName(marked.where(F.col("keep").isNotNull()))
    alone = F.col("keep").isNull()
    return both.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The documents that stay, with all their columns.

    Only digests of two or more rows are joined to the texts: by broadcast where they are few, else by a
    shuffle that adaptive execution may split."""
    keyed = c.stage(docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), F.lit(0).cast("long").alias("rid")), "digests")
    heavy = c.stage(heavy_digests(keyed, share), "heavy")
    rest = keyed.join(F.broadcast(heavy), "digest", "left_anti").groupBy("digest").agg(*_aggregates()).where(F.col("group_size") > 1)
    groups = c.stage(heavy.unionByName(rest).select("digest", F.col("keep.doc_id").alias("keep_id")), "groups")
    groups = groups.select("digest", "keep_id", F.lit(True).alias("several"))
    inner, at = c.by_place(docs)
    joined = c.join_checked(inner.withColumn("digest", text_digest(at["text"])), groups, ["digest"], "left")
    alone = joined.where(F.col("several").isNull()).select(*at.values())
    firsts = joined.where(F.col("several") & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("keep_id")))
    # rows that repeat both text and doc_id are one row again; each key has few rows by now
    return alone.unionByName(firsts.dropDuplicates(["digest"]).select(*at.values())).toDF(*docs.columns)
