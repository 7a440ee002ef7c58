"""A Python data source for archives of candles: a file for each symbol, month and side, of LZMA-compressed binary records.

    spark.dataSource.register(CandleFiles)
    spark.read.format("candle_files").load(path)          # also readStream and write

A file is {path}/{symbol}/{yyyy-mm}/{SIDE}.bi5, LZMA in its old container, of records of 24 bytes, big-endian: seconds since the month began, then
open, close, low, high in points, and volume. Reading lists the archive once, on the driver, and deals its files out by PART_BYTES a task;
a task decompresses a file piece by piece, so it holds PIECE bytes of it. A file whose size is no whole number of records raises ValueError. Option
`symbol` reads one symbol's folder alone; `point` is the price of a point (0.01).

Writing wants a file's rows in one task (`write_candles` deals them so). A task writes to names of its own attempt, which the driver gives their
final names when all tasks are done; after a failure it removes them. The stream reader takes files in the order they came; its offset is
how many it has seen. Paths are those of pyarrow's file systems (local, S3, GCS, HDFS)."""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..cluster import ship

#: The record, and the columns of a row.
RECORD = np.dtype([("seconds", ">i4"), ("open", ">i4"), ("close", ">i4"), ("low", ">i4"), ("high", ">i4"), ("volume", ">f4")])
SCHEMA = "symbol string, side string, t bigint, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close")
#: Compressed bytes of files that one task reads, and bytes that a task decompresses at once.
PART_BYTES = 32 << 20
PIECE = RECORD.itemsize << 14
_ARROW = pa.schema([("symbol", pa.string()), ("side", pa.string()), ("t", pa.int64()), *((p, pa.float64()) for p in PRICES), ("volume", pa.float64())])


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def month_start(month: str) -> int:
    return int(datetime.strptime(month, "%Y-%m").replace(tzinfo=timezone.utc).timestamp())


def pieces(handle, size: int = PIECE) -> Iterator[bytes]:
    """The decompressed bytes of an open file, `size` at most at a time."""
    unpack, fed = lzma.LZMADecompressor(format=lzma.FORMAT_ALONE), b""
    while not unpack.eof:
        if unpack.needs_input:
            fed = handle.read(1 << 16)
            if not fed:
                break
        yield unpack.decompress(fed if unpack.needs_input else b"", size)


def decoded(handle, name: str, point: float) -> Iterator[pa.RecordBatch]:
    """Rows of one file; name ends in symbol/month/side.bi5."""
    symbol, month, file = name.split("/")[-3:]
    base, rest = month_start(month), b""
    for piece in pieces(handle):
        piece = rest + piece
        whole = len(piece) // RECORD.itemsize * RECORD.itemsize
        rows, rest = np.frombuffer(piece[:whole], RECORD), piece[whole:]
        n = len(rows)
        if n:
            columns = [pa.array([symbol] * n), pa.array([file.split(".")[0]] * n), pa.array(rows["seconds"].astype(np.int64) + base)]
            columns += [pa.array(rows[p].astype(np.float64) * point) for p in PRICES]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows["volume"].astype(np.float64))], schema=_ARROW)
    if rest:
        raise ValueError(f"{name}: not a whole number of records")


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class _Archive:
    def __init__(self, options: dict) -> None:
        self.path, self.symbol, self.point = options["path"], options.get("symbol"), float(options.get("point", "0.01"))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, name, size) of the archive's files, in the order they came."""
        from pyarrow import fs

        store, root = _fs(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{self.symbol}" if self.symbol else root, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.endswith(".bi5"))

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        parts, names, size = [], [], 0
        for _, name, n in files:
            if names and size + n > PART_BYTES:
                parts.append(Files(tuple(names)))
                names, size = [], 0
            names.append(name)
            size += n
        return [*parts, Files(tuple(names))] if names else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _fs(self.path)
        for name in partition.names:
            with store.open_input_stream(name) as handle:
                yield from decoded(handle, name, self.point)


class _Reader(_Archive, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files(())]


class _StreamReader(_Archive, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": len(self.listed())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt(self.listed()[start["seen"] : end["seen"]])


@dataclass
class Written(WriterCommitMessage):
    names: tuple[tuple[str, str], ...]  # own name, final name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.point = options["path"], float(options.get("point", "0.01"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file for each run of rows of a symbol, month and side; rows come sorted by those and t."""
        store, root = _fs(self.path)
        now, pack, out, names = None, None, None, []

        def close() -> None:
            if out is not None:
                out.write(pack.flush())
                out.close()

        for batch in batches:
            rows = batch.to_pydict()
            month = [datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m") for t in rows["t"]]
            keys = list(zip(rows["symbol"], month, rows["side"], strict=True))
            heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for i, j in zip(heads, [*heads[1:], len(keys)], strict=True):
                if keys[i] != now:
                    close()
                    now, folder = keys[i], f"{root}/{keys[i][0]}/{keys[i][1]}"
                    store.create_dir(folder, recursive=True)
                    names.append((f"{folder}/.{keys[i][2]}-{uuid.uuid4().hex}", f"{folder}/{keys[i][2]}.bi5"))
                    pack, out = lzma.LZMACompressor(format=lzma.FORMAT_ALONE), store.open_output_stream(names[-1][0])
                made = np.zeros(j - i, RECORD)
                made["seconds"] = np.array(rows["t"][i:j]) - month_start(now[1])
                for p in PRICES:
                    made[p] = np.rint(np.array(rows[p][i:j]) / self.point)
                made["volume"] = rows["volume"][i:j]
                out.write(pack.compress(made.tobytes()))
        close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _fs(self.path)
        final = [m for w in messages if w for m in w.names]
        if len({to for _, to in final}) < len(final):
            self.abort(messages)
            raise ValueError("a file's rows are in several tasks")
        for own, to in final:
            store.move(own, to)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _fs(self.path)
        for own, _ in (m for w in messages if w for m in w.names):
            store.delete_file(own)


class CandleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candle_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CandleFiles)


def write_candles(rows: DataFrame, path: str, point: float = 0.01) -> None:
    """Rows of SCHEMA to an archive; a file is the unit of a task."""
    register(rows.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    dealt = rows.select(*names).withColumn("_m", F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86_400).cast("int")), "month"))
    dealt = dealt.repartition("symbol", "_m", "side").sortWithinPartitions("symbol", "_m", "side", "t").drop("_m")
    dealt.write.format("candle_files").mode("append").option("point", str(point)).save(path)


def mids(candles: DataFrame) -> DataFrame:
    """symbol, t, open, high, low, close, volume (the bid's): the middle of bid and ask where both sides traded. Fillers, of no volume, are no candles."""
    traded = candles.where("volume > 0")
    side = lambda name, x: traded.where(F.col("side") == name).select("symbol", "t", *(F.col(c).alias(f"{x}_{c}") for c in (*PRICES, "volume")))
    both = side("BID", "b").join(side("ASK", "a"), ["symbol", "t"])
    return both.select("symbol", "t", *(((F.col(f"b_{p}") + F.col(f"a_{p}")) / 2).alias(p) for p in PRICES), F.col("b_volume").alias("volume"))
