"""Token counts of flat, unindexed token files.

A token file is a row of little-endian identifiers, 2 or 4 bytes each, in which an end-of-document identifier
closes each document. Files are scanned in blocks: a vectorised comparison finds the separators of a block, and
gives the lengths of documents that lie within it, the tokens before its first and after its last separator.
Documents that cross blocks are stitched by a prefix scan over the blocks of a file, which is a window over one
row a block. Files are written by Spark's text sink: a row is a document's identifiers, and the bytes that part rows
are the separator's own, so writing needs no index and no driver. The same rows' doc_ids go, by the same task, to files of
their own, 9 bytes and a separator each: the nth document of a token file is the nth of the name file beside it, whichever tasks run
or run again.

Defined cases: null and empty texts are documents of no tokens; repeated rows are documents each; an empty
table gives no document; other columns are ignored. A file is one value in a task, so it may have 2 GB at most; a file written
here ends with the document that passes FILE_BYTES, however many it holds. A file whose last document lacks its separator raises ValueError,
as does a file whose size is not a multiple of the identifier's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from . import sentencepiece as sp

#: Identifiers in a block.
BLOCK_TOKENS = 1 << 19
#: Bytes of an identifier, and the separator (</s> of the model in sentencepiece.py).
WIDTH = 2
SEPARATOR = 2
#: Bytes of tokens and names after which a task begins new files, and the files a task may have open.
FILE_BYTES = 64 << 20
OPEN_FILES = 1_000
_CONCURRENT = "spark.sql.maxConcurrentOutputFileWriters"
_NAME_BYTES = 9 + WIDTH


def write_files(docs: DataFrame, path: str, model_path: str = sp.MODEL_PATH, file_bytes: int = FILE_BYTES) -> None:
    """Encode the texts of docs; write tokens to flat files under path/kind=tokens, and doc_ids in the same order to path/kind=names.

    A task's files are numbered by the bytes before them (roll), the same for both kinds."""
    spark = docs.sparkSession
    c.small_batches(spark)
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sp._model(proto.value)
        if len(model.pieces) > 1 << 8 * WIDTH:
            raise ValueError("the vocabulary does not fit the identifier's width")
        written = 0
        for batch in batches:
            data, off = c.utf8(batch.column(1))
            for i, j in c.chunks(off):
                ids, ends = model.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                upto = written + np.cumsum(np.diff(ends) * WIDTH + WIDTH + _NAME_BYTES)
                roll, written = pa.array(np.concatenate(([written], upto[:-1])) // file_bytes), int(upto[-1])
                names = np.zeros((j - i, 9), np.uint8)
                doc = batch.column(0).slice(i, j - i)
                names[:, 0] = doc.is_null().to_numpy(zero_copy_only=False)
                names[:, 1:] = doc.fill_null(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
                for kind, raw, at in (("tokens", ids.astype("<u2").tobytes(), ends * WIDTH), ("names", names.tobytes(), np.arange(j - i + 1) * 9)):
                    values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * (j - i)), roll, values], names=["kind", "roll", "value"])

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "kind string, roll long, value binary")
        .select("kind", "roll", F.col("value").cast("string"))
    )
    mark = SEPARATOR.to_bytes(WIDTH, "little").decode("latin-1")
    before = spark.conf.get(_CONCURRENT)
    spark.conf.set(_CONCURRENT, str(OPEN_FILES))  # all of a task's files stay open, so that rows are not sorted and keep their order
    try:
        rows.write.partitionBy("kind", "roll").option("lineSep", mark).option("encoding", "ISO-8859-1").text(path)
    finally:
        spark.conf.set(_CONCURRENT, before)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    )


def _place() -> tuple:
    """Roll and task of a written file, from its path."""
    return tuple(F.regexp_extract("file", r"roll=(\d+)/part-(\d+)-", i).cast("long").alias(n) for i, n in ((1, "roll"), (2, "task")))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, doc_id of every row of the name files under path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, _NAME_BYTES)
                ids = np.ascontiguousarray(rows[:, 1:9]).view("<i8").ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows)), pa.array(np.arange(len(rows))), pa.array(ids, mask=rows[:, 0] > 0)],
                    names=["file", "ordinal", "doc_id"],
                )

    return _files(spark, path).mapInArrow(read, "file string, ordinal long, doc_id long")


def scan_blocks(spark: SparkSession, path: str, block: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """file, block, head, tail, n_ends, inner: what each block says of the documents it holds."""
    schema = "file string, block long, head long, tail long, n_ends long, inner array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if raw.size % WIDTH:
                    raise ValueError(f"{name}: not a whole number of identifiers")
                ids = np.frombuffer(raw, "<u2")
                for k in range(0, len(ids), block):
                    part = ids[k : k + block]
                    ends = np.flatnonzero(part == separator)
                    head = int(ends[0]) if len(ends) else len(part)
                    tail = len(part) - 1 - int(ends[-1]) if len(ends) else len(part)
                    inner = np.diff(ends) - 1
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [name], "block": [k // block], "head": [head], "tail": [tail], "n_ends": [len(ends)],
                            "inner": [inner.astype(np.int64)],
                        },
                        schema=kinds,
                    )

    kinds = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("n_ends", pa.int64()),
        ("inner", pa.list_(pa.int64())),
    ])
    return _files(spark, path).mapInArrow(scan, schema)


def count_tokens(spark: SparkSession, path: str, block: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal (from 0 in the file), n_tokens of every document under path."""
    c.small_batches(spark)
    blocks = c.stage(scan_blocks(spark, path, block, separator), "blocks")
    line = Window.partitionBy("file").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    # tokens since the last separator: running sum of tails, less what it was at the last block with a separator
    run = F.coalesce(F.sum("tail").over(before), F.lit(0))
    here = F.when(F.col("n_ends") > 0, F.col("run"))
    scanned = blocks.withColumn("run", run).withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    scanned = scanned.withColumn("base", F.coalesce(F.last(here, ignorenulls=True).over(before), F.lit(0)))
    carried = F.col("run") - F.col("base")
    last = F.col("block") == F.max("block").over(Window.partitionBy("file"))
    open_end = F.when(last & (F.col("tail") > 0), F.raise_error(F.concat(F.lit("the last document lacks its separator: "), F.col("file"))))
    counts = F.when(F.col("n_ends") > 0, F.concat(F.array(carried + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    scanned = scanned.withColumn("counts", F.coalesce(open_end.cast("array<bigint>"), counts))
    return (
        scanned.select("file", "first", F.posexplode("counts").alias("k", "n_tokens"))
        .select("file", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), F.col("n_tokens").cast("long"))
    )


def document_counts(
    docs: DataFrame, model_path: str = sp.MODEL_PATH, block: int = BLOCK_TOKENS, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """doc_id, n_tokens: docs written to token files and counted from the files alone, with the names written beside them.

    The query fails if a document is missing from either."""
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    path = c.new_path(spark, "tokens")
    write_files(docs, path, model_path, file_bytes)
    names = read_names(spark, f"{path}/kind=names").select(*_place(), "ordinal", "doc_id", F.lit(True).alias("named"))
    found = count_tokens(spark, f"{path}/kind=tokens", block).select(*_place(), "ordinal", "n_tokens")
    both = names.join(found, ["task", "roll", "ordinal"], "full")
    broken = F.when(
        F.col("n_tokens").isNull() | F.col("named").isNull(), F.raise_error(F.lit("a document is missing from the token files or the names")),
    )
    return both.select("doc_id", F.coalesce(broken.cast("long"), F.col("n_tokens")).alias("n_tokens"))
