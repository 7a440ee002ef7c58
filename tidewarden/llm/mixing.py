"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents have the same expected number of copies, target / source_size. The running sum of
expected copies along a fixed order of the source's documents, plus one random offset for the source, is cut
at the integers: a document is taken once for each integer passed. The order runs through classes of size, so
that the words taken differ from the target by about one document's at most.

The running sum is made in two levels (counts of bins, then ranks within a bin), so that a source with a third
of all rows is spread over many tasks.

Defined cases: null text has size 0; a null source is a source of its own, last in order; repeated rows are
drawn each on its own; an empty table gives an empty result; other columns are carried through by `mix_documents`.
A source without words has target 0 and gives nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Weights of the sources in code-point order, repeating; share of all words; most times a document is taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def n_words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Capped shares: sources are met in the order of most * size / weight; the level is the first at which what the
    capped ones leave, divided by the remaining weight, is no more than the next source's own bound."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    bound = F.lit(most) * F.col("source_size")
    before = Window.orderBy((bound / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    at = F.row_number().over(Window.orderBy((bound / F.col("weight")).asc(), F.col("source").asc_nulls_last()))
    per = per.withColumn("at", at)
    level = F.min(F.when(F.col("level") <= bound / F.col("weight"), F.struct("at", "level"))).over(everything)["level"]
    return per.select("source", F.col("source_size").cast("long"), F.least(bound, F.coalesce(F.col("weight") * level, bound)).alias("target"))


def size_class(size):
    """Four classes to each doubling of the size."""
    octave = F.floor(F.log2(size.cast("double") + F.lit(0.5)))
    quarter = F.floor(size.cast("double") * 4 / F.pow(F.lit(2.0), octave.cast("double"))) - 4
    return F.when(size < 1, F.lit(-1).cast("long")).otherwise(octave * 4 + quarter)


def copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (with doc_id, source, size and any other columns) with source_size, target and `copies` (long)."""
    named = lambda x: f"__mix_{x}"
    h, key, first = named("hash"), [named("source"), named("class"), named("bin")], named("first")
    source = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    keyed = docs.withColumn(h, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn(key[0], source).withColumn(key[1], size_class(F.col("size"))).withColumn(key[2], F.substring(h, 1, 2))
    order = Window.partitionBy(key[0]).orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))  # at most about 100 * 256 to a source
    bins = bins.select(*key, F.coalesce(F.sum("n").over(order), F.lit(0)).alias(first))
    offset = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10,
    ).cast("double") / F.lit(4294967296.0)
    info = c.join_checked(bins, targets.select(source.alias(key[0]), "source_size", "target", offset.alias(named("offset"))), [key[0]], "inner")
    ranked = keyed.withColumn(named("rank"), F.row_number().over(Window.partitionBy(*key).orderBy("size", h, "doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col(first) + F.col(named("rank"))
    passed = lambda x: F.floor(x.cast("double") * rate + F.col(named("offset")))
    return ranked.join(info, key).select(*docs.columns, "source_size", "target", (passed(upto) - passed(upto - 1)).cast("long").alias("copies"))


def mix_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document)."""
    sizes = c.stage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words().alias("size")), "sizes")
    out = copies(sizes, c.stage(source_targets(sizes), "targets"), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs."""
    sizes = c.stage(docs.select("source", n_words().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    named, at = c.by_place(docs)
    inner = named.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.struct(*at.values()).alias("row"), n_words(at["text"]).alias("size"))
    drawn = copies(inner, c.stage(source_targets(sizes), "targets"), seed).where(F.col("copies") > 0)
    taken = drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*(F.col(f"row.{n}").alias(n) for n in at.values())).toDF(*docs.columns)
