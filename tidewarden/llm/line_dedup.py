"""Lines that recur across documents: exploded, keyed, counted by hash, dropped over a threshold, reassembled by position.

A line is what lies between two \\n; its key is the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of
MIN_CHARS code points or more that MIN_DOCS documents or more hold lose all their lines, except in the document of the largest
doc_id that holds them. Keys meet as 128-bit hashes (MD5).

One pass explodes each document's distinct keys and counts documents by hash, with map-side combining, so a line that a third of
all documents hold costs a row a task. A second pass explodes lines with their positions and joins the frequent hashes: by
broadcast where their measured bytes allow; else the hashes over HEAVY_SHARE of all rows, of which there are 1 / HEAVY_SHARE at
most, by broadcast and the others by a shuffle. The positions found are brought back to the texts by row number.

Defined cases: null and empty texts are one empty line; each row is a document of its own, also where doc_ids repeat or are null;
a null doc_id is smaller than any other; rows that share the largest doc_id all keep their lines; a line repeated in one document
counts once and stays or goes with all its places; very long texts are taken whole; other columns, whatever their names, are
carried through by `drop_lines`; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MIN_CHARS = 40
MIN_DOCS = 5
#: Share of all keyed lines above which a hash is joined by broadcast whatever the number of frequent hashes.
HEAVY_SHARE = 1 / 1000

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def frequent_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, n_docs, last (largest doc_id) of the keys that min_docs rows of (doc_id, text) or more hold."""
    wide = F.filter(_lines(F.col("text")), lambda x: F.octet_length(x) >= min_chars)
    keys = F.array_distinct(F.transform(wide, line_key))
    keyed = rows.select("doc_id", F.explode(keys).alias("key")).where(F.char_length("key") >= min_chars)
    counted = keyed.groupBy(_hash(F.col("key")).alias("hash")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("n_docs") >= min_docs)


def _found(rows: DataFrame, frequent: DataFrame, min_chars: int, limit: int, share: float) -> DataFrame:
    """row, places: positions of the lines that go, for the rows that lose any."""
    lines = rows.select("row", "doc_id", F.posexplode(_lines(F.col("text"))).alias("place", "line")).where(F.octet_length("line") >= min_chars)
    keyed = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    keyed = keyed.select("row", "doc_id", "place", _hash(F.col("line")).alias("hash"))
    if c.small(frequent, limit):
        met = keyed.join(F.broadcast(frequent), "hash")
    else:
        least = share * frequent.agg(F.sum("n_docs")).first()[0]
        heavy = c.stage(frequent.where(F.col("n_docs") > least), "heavy-lines")  # 1 / share rows at most
        light = keyed.join(F.broadcast(heavy), "hash", "left_anti").join(frequent.where(F.col("n_docs") <= least), "hash")
        met = keyed.join(F.broadcast(heavy), "hash").unionByName(light)
    gone = met.where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("row").agg(F.collect_list("place").alias("places"))


def mark_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, limit: int = c.BROADCAST_BYTES, share: float = HEAVY_SHARE,
) -> DataFrame:
    """The rows of docs, columns renamed c0, c1, ... in order, with `places`: positions of the lines that go (null: none)."""
    inner, at = c.by_place(docs)
    inner = c.stage(inner.withColumn("row", F.monotonically_increasing_id()), "lines")
    rows = inner.select("row", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text"))
    frequent = c.stage(frequent_lines(rows, min_chars, min_docs), "frequent-lines")
    found = c.stage(_found(rows, frequent, min_chars, limit, share), "dropped-lines")
    return c.join_checked(inner, found, ["row"], "left", limit)


def _kept(text: str | None, places: list[int] | None) -> tuple[str, int]:
    """The text without the lines at these positions, and its number of lines before."""
    text = text or ""
    if not places:
        return text, text.count("\n") + 1
    lines, gone = text.split("\n"), set(places)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines)


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines taken out of text (a text without any stays as it is, null too); other columns unchanged."""
    c.small_batches(docs.sparkSession)
    marked = mark_lines(docs, **options).drop("row")
    of = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_kept(t, p)[0] if p else t for t, p in zip(b.column(of).to_pylist(), b.column("places").to_pylist(), strict=True)]
            columns = [pa.array(texts, b.schema.field(of).type) if i == of else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return marked.mapInArrow(run, T.StructType(marked.schema.fields[:-1])).toDF(*docs.columns)


def line_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    c.small_batches(docs.sparkSession)
    marked = mark_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options).select("c0", "c1", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(2).to_pylist()
            kept = [_kept(t, p) for t, p in zip(b.column(1).to_pylist(), places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([n for _, n in kept], pa.int64()), pa.array([len(p or ()) for p in places], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _ in kept]),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return marked.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
