"""WARC archives: writing pages as records, and reading archives back in sequence.

A record is one gzip member; an archive is some members one after another. Spark's text sink writes the
archives, one row of bytes a file, to any store Hadoop reaches; the bytes it puts after the row are an empty
gzip member, as block-compressed formats end their files. The reader decompresses incrementally, frames each
record by Content-Length and verifies the SHA-1 digests of block and payload.

Defined cases: null html is an empty payload; null url gives urn:page:<page_id>; a null page_id is written as
record `null` and read back as null (it is never the response that others refer to, unless no other is);
repeated page_ids are records each, and of those that repeat both the largest page_id and the payload one is the response;
an empty table gives no archive and an empty result; other columns are ignored. Records of other writers are read too: of any
type, with any record id (page_id is null then), with or without digests. A record that is cut short, framed wrongly or
fails a SHA-1 digest raises ValueError. An archive is one value in a task, so it may have 2 GB at most; those written here
have about ARCHIVE_BYTES and one record more."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Compressed bytes after which a new archive begins.
ARCHIVE_BYTES = 4 << 20
#: Bytes of compressed input given to the decompressor at once.
READ_BYTES = 1 << 16
#: Payload bytes from which equal payloads are written as revisits.
REVISIT_BYTES = 0

_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(value: str | None) -> int | None:
    """The page's number in a record id that `_id` made; None for others."""
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.removeprefix("-").isdigit() else None


def _bare(digest: str | None) -> str | None:
    return digest.removeprefix("sha1:") if digest and digest.startswith("sha1:") else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member with a response record, or a revisit record that leaves the payload out."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one after another; empty members are passed over."""
    unpack, out, fed = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            out.append(unpack.decompress(piece))
            fed = True
            piece = unpack.unused_data
            if unpack.eof:
                if content := b"".join(out):
                    yield content
                unpack, out, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends within a record")


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n"))}


def read_records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Records of an archive in order: headers, block; framed by Content-Length, digests verified."""
    for content in members(pieces):
        end = content.find(b"\r\n\r\n")
        if end < 0 or not content.startswith(b"WARC/1."):
            raise ValueError("a record without a WARC header")
        head = _headers(content[:end].partition(b"\r\n")[2])
        size = int(head.get("content-length", -1))
        block = content[end + 4 : end + 4 + size]
        if size < 0 or len(block) != size or content[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("Content-Length does not frame the record")
        if (want := _bare(head.get("warc-block-digest"))) and want != sha1_base32(block):
            raise ValueError("the block's digest differs")
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
            top, _, payload = block.partition(b"\r\n\r\n")
            http = _headers(top.partition(b"\r\n")[2])
        if head.get("warc-type") != "revisit" and (want := _bare(head.get("warc-payload-digest"))) and want != sha1_base32(payload):
            raise ValueError("the payload's digest differs")
        yield {"head": head, "http": http, "payload": payload}


def write_pages(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least: int = REVISIT_BYTES) -> None:
    """Write a record for each row (page_id, url, html) to archives under path.

    Of records with equal payloads of `least` bytes or more, that with the largest page_id is the response and
    the others revisit it. Groups are found by digest: (digest, page_id) is shuffled with map-side combining;
    only digests of two or more pages are joined back. Rows are told apart by what they hold, not by a place in a scan; rows
    that repeat a group's largest page_id are written to a table with numbers, and the first of them is the response."""
    c.small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keyed = c.stage(base.where(F.octet_length("html") >= least).select("digest", "page_id"), "payload-digests")
    ids = keyed.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    same = ids.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where(F.col("n") > 1)
    same = c.stage(same.select("digest", F.col("top.page_id").alias("top_id"), F.col("top.n").alias("n_top")), "equal-payloads")
    joined = c.join_checked(base, same, ["digest"], "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top_id"))
    tied = F.coalesce(is_top & (F.col("n_top") > 1), F.lit(False))
    plain = joined.where(~tied).withColumn("revisit", F.col("n_top").isNotNull() & ~is_top)
    if not same.where("n_top > 1").isEmpty():
        several = c.stage(joined.where(tied).withColumn("rid", F.monotonically_increasing_id()), "repeated-responses")
        firsts = c.stage(several.groupBy("digest").agg(F.min("rid").alias("first_rid")), "first-responses")
        several = c.join_checked(several, firsts, ["digest"], "inner").withColumn("revisit", F.col("rid") != F.col("first_rid"))
        plain = plain.unionByName(several.select(*plain.columns))
    joined = plain.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("top_id")).alias("refers_to"), "revisit")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                payload = html.encode()
                parts.append(record(page_id, url, payload, sha1_base32(payload), refers_to, revisit))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"archive": [b"".join(parts)]})

    out = joined.mapInArrow(archives, "archive binary")
    sink = out.select(F.col("archive").cast("string").alias("value")).write
    sink.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


_READ = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _row(r: dict) -> dict:
    head, revisit, payload = r["head"], r["head"].get("warc-type") == "revisit", r["payload"]
    told = r["http"].get("content-length", "")
    size = int(told) if told.isdigit() and (revisit or "content-encoding" not in r["http"]) else len(payload)
    if not revisit and told.isdigit() and size != len(payload) and "transfer-encoding" not in r["http"]:
        raise ValueError("Content-Length of the response differs from its payload")
    return {
        "page_id": _page(head.get("warc-record-id")), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": _bare(head.get("warc-payload-digest")) or (None if revisit else sha1_base32(payload)),
        "record_type": head.get("warc-type"), "refers_to": _page(head.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload,
    }


def read_archives(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record under path."""
    c.small_batches(spark)
    schema = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view, rows, held = memoryview(content.as_buffer()), [], 0
                for r in read_records(bytes(view[i : i + READ_BYTES]) for i in range(0, len(view), READ_BYTES)):
                    rows.append(_row(r))
                    held += len(r["payload"])
                    if held >= c.CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("content").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    path = c.new_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
