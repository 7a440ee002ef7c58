"""Shared pieces of the corpus operators: staging of intermediate tables, and word and hash
arithmetic over the byte buffers of Arrow string columns."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Bytes of text that one numpy pass takes at most (a longer document is a pass of its own).
CHUNK_BYTES = 1 << 18
#: Bytes that a broadcast side may have (its values, plus 32 for each row); larger sides are joined by shuffle.
BROADCAST_BYTES = 16 << 20

_OWN_DIR: list[str] = []
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one where it is unset and the master is local."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when this Python process ends."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex[:12]}-{label}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their place (c0, c1, ...), and those names by the old ones: no name of docs, whatever its signs,
    can then meet one that an operator adds. `toDF(*docs.columns)` undoes it."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to about 2 MB, whatever the length of the rows (for the whole session); give the workers this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def small(side: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's rows have `limit` bytes at most, by a count and the lengths of its strings and arrays."""
    wide = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in side.dtypes if kind in ("string", "binary")]
    wide += [F.greatest(F.size(n), F.lit(0)) * 8 for n, kind in side.dtypes if kind.startswith("array")]
    fixed = 32 + sum(64 if kind.startswith("struct") else 8 for _, kind in side.dtypes)
    got = side.agg(F.sum(sum(wide, F.lit(fixed).cast("long"))).alias("bytes")).first()
    return (got["bytes"] or 0) <= limit


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a staged, narrow right side: broadcast when it has at most `limit` bytes, else by shuffle."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


# --- bytes of a string column -------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: The bytes that part words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240611)
_MULT = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which of 8 little-endian bytes count when so many are left.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes from which a span is hashed and compared in one piece instead of 8 bytes a step beside others.
_LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that `space` doesn't mark), and each row's number of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~space[data]
    edge = off[(off > 0) & (off < len(data))]
    before = np.empty(len(word), bool)
    before[0] = False
    before[1:] = word[:-1]
    before[edge] = False
    after = np.empty(len(word), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number (a view over a copy); zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def lanes(data: np.ndarray) -> np.ndarray:
    """The same as an array of its own, 8 bytes a place."""
    return np.ascontiguousarray(_lanes(data)).astype(np.uint64, copy=False)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes.

    Each 8 bytes of a span go through `mix` with the hash so far, for all spans side by side; spans over _LONG bytes
    are hashed by BLAKE2. Different spans collide with odds of 2^-64 a pair; where equality decides, compare bytes
    as well (`equal_spans`, `repeats`)."""
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _MULT[63])
    lanes, live, at = _lanes(data), np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        left = size[live] - at
        out[live] = mix((out[live] ^ (lanes[starts[live] + at] & _KEEP[np.minimum(left, 8)])) * _MULT[62])
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether spans of a (places, sizes) have the bytes of those of b beside them."""
    same = size_a == size_b
    lanes_a, at = _lanes(a), 0
    lanes_b = lanes_a if b is a else _lanes(b)
    live = np.flatnonzero(same & (size_a > 0) & (size_a <= _LONG))
    while len(live):
        left = size_a[live] - at
        differ = (lanes_a[at_a[live] + at] ^ lanes_b[at_b[live] + at]) & _KEEP[np.minimum(left, 8)] != 0
        same[live[differ]] = False
        live, at = live[~differ & (left > 8)], at + 8
    for i in np.flatnonzero(same & (size_a > _LONG)):
        same[i] = np.array_equal(a[at_a[i] : at_a[i] + size_a[i]], b[at_b[i] : at_b[i] + size_b[i]])
    return same


def repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which spans (in order) have the bytes of an earlier span of their row. Hashes find candidates, bytes decide."""
    keys = mix(span_hashes(data, starts, ends) ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    a, b = order[:-1], order[1:]
    hit = keys[a] == keys[b]
    a, b, again = a[hit], b[hit], np.zeros(len(keys), bool)
    again[b] = True
    if not ((rows[a] == rows[b]) & equal_spans(data, starts[a], data, starts[b], ends[a] - starts[a], ends[b] - starts[b])).all():
        seen: set = set()  # different bytes with one hash
        for i, (row, x, y) in enumerate(zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True)):
            again[i] = (row, text := data[x:y].tobytes()) in seen
            seen.add((row, text))
    return again


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring values each; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULT[0]
    for i in range(1, k):
        out += h[i : i + n] * _MULT[i]
    return mix(out)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as 64-bit hashes, sorted within the row, with offsets (n + 1).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a row of fewer than k words has its whole
    sequence as its one shingle; a row without words has none."""
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    n = len(counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    grams = window_hashes(words, k)
    rows, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(grams):
        row_of = np.repeat(np.arange(n), counts)
        ok = row_of[: len(grams)] == row_of[k - 1 :]
        rows, values = row_of[: len(grams)][ok], grams[ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = mix(counts[short].astype(np.uint64) * _MULT[62])
        for i in range(k - 1):
            has = counts[short] > i
            h[has] += words[first[short[has]] + i] * _MULT[i + 8]
        rows, values = np.concatenate((rows, short)), np.concatenate((values, mix(h)))
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    bounds = np.searchsorted(rows, np.arange(n + 1))
    for i in range(n):
        values[bounds[i] : bounds[i + 1]].sort()
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        rows, values = rows[new], values[new]
        bounds = np.searchsorted(rows, np.arange(n + 1))
    return values, bounds


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags in each row's bytes."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]
