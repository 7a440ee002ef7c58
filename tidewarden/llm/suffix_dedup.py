"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a WIDTH-byte string that also starts in a document of a smaller doc_id goes; strings are
judged on the input. Whole copies of a text are settled by digest first; of the rest:

1. A shard is a chunk of documents. Of its suffixes, those at anchors are listed: the leftmost smallest hash of
   GRAM bytes in each window of WIDTH bytes, so equal windows have equal anchors at equal places. Each shard's sorted list is dealt
   out by another hash of the same bytes, and merged with the others by binary search: anchors of two documents or more are shared.
   This step only saves work: a window whose anchor one document has stands in no other document.
2. Around shared anchors, the shard cuts out the text of the windows that the anchor governs. Equal cuttings within
   a shard are settled there; one text of each goes on with all its places in the smallest document, dealt out by the anchor's hash.
   Hashes find equal cuttings, their bytes decide.
3. Cuttings of one anchor that differ, without windows that can't start in another document by the bytes beside the anchor, are
   joined to a text, whose suffix array is refined as by Larsson and Sadakane (ranks by
   8 bytes, doubled until they cover WIDTH). Common prefixes of neighbours (Kasai's array, all neighbours at once, 8 bytes a
   step) part it into intervals of equal strings; in each, all documents but the smallest lose the string, at every place.
4. Covered ranges of a document are merged, and what is left is hashed.

Defined cases: null text is empty; a null doc_id comes after all others, and null ones are one document; rows that repeat
a doc_id never remove from one another; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WIDTH = 50
GRAM = 28
#: Text bytes of a shard; buckets that it is dealt to at least, and at most unless buckets were to hold more than the second
#: number below: a shard's blobs would else become as many, and as small, as the input is large.
SHARD_BYTES = 8 << 20
LEAST_BUCKETS = 64
MOST_BUCKETS = 320
#: Anchors and cuttings a bucket is to hold about, and at most.
BUCKET_ANCHORS = (200_000, 4_000_000)
BUCKET_CUTTINGS = (40_000, 400_000)
#: Bits of an anchor's hash that are listed: at 1 TB of text, three anchors in 10,000 look shared that are not.
HASH_BITS = 48
#: Bytes in which anchors are looked for at once (small, so that arrays stay in cache), and the bits of a place there; texts go piece by piece.
PIECE_BYTES = 1 << 17
_PLACE = np.uint64(24)

_LAST = np.iinfo(np.int64).max
_CODEC = pa.Codec("zstd", 1)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- suffix arrays ------------------------------------------------------------------------------


def words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)].astype(np.uint64)
    return out


def _ranked(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank (place of the first equal one) of each element, given the order that sorts the keys."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    at = np.flatnonzero(new)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, len(order))))
    return rank


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text in order of their first `depth` bytes (all, if None), and each suffix's rank.

    Larsson-Sadakane refinement: ranks by h bytes give ranks by 2 h bytes, and only groups of equal rank are sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = words8(text)
    left = np.minimum(n - np.arange(n), 8)  # a suffix that ends sorts before one that goes on
    order = np.lexsort((left, first))
    rank, h = _ranked(order, first, left), 8
    while True:
        size = np.bincount(rank, minlength=n)[rank]
        open_ = np.flatnonzero(size > 1)
        if not len(open_) or (depth is not None and h >= depth):
            break
        step = h if depth is None or 2 * h <= depth else depth - h
        beyond = open_ + step
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        sub = np.lexsort((after, rank[open_]))
        places = np.sort(rank[open_], kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        within = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
        order[places + within] = open_[sub]
        new = np.ones(len(sub), bool)
        a, b = after[sub], rank[open_][sub]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        rank = rank.copy()
        rank[open_[sub]] = np.repeat((places + within)[at], np.diff(np.append(at, len(sub))))
        h += step
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, up to cap, that each suffix has in common with the one before it in order (0 for the first)."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    word = words8(text)
    a, b = order[:-1], order[1:]
    alive = np.arange(1, n)
    for h in range(0, cap, 8):
        x, y = a[alive - 1] + h, b[alive - 1] + h
        room = np.minimum(len(text) - np.maximum(x, y), 8)
        ok = room > 0
        diff = np.where(ok, word[np.minimum(x, len(text) - 1)] ^ word[np.minimum(y, len(text) - 1)], np.uint64(1 << 63))
        same = np.full(len(alive), 8)
        for k in range(8):
            hit = (same == 8) & ((diff >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0)
            same[hit] = k
        same = np.minimum(same, np.maximum(room, 0))
        out[alive] += same
        alive = alive[same == 8]
        if not len(alive):
            break
    return np.minimum(out, cap)


def repeated_starts(text: np.ndarray, docs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of starts (places in text) begin a string of width bytes that also starts at a place of a smaller document."""
    order, _ = suffix_array(text, width)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    lcp = common_prefixes(text, order, width)
    interval = np.cumsum(lcp < width)
    chosen = is_start[order]
    doc_of = np.zeros(len(text), np.int64)
    doc_of[starts] = docs
    at, group = order[chosen], interval[chosen]
    least = np.full(int(group.max(initial=0)) + 1, _LAST)
    np.minimum.at(least, group, doc_of[at])
    hit = np.zeros(len(text), bool)
    hit[at] = doc_of[at] > least[group]
    return hit[starts]


# --- anchors ------------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of w values from each place on."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """hash, row, first and last window start, and place of each anchor; places count in data.

    An anchor governs the windows from the first to the last start. Which place is a window's anchor depends on the window's bytes alone."""
    if not gram < width <= gram + 200:
        raise ValueError(f"width must be from {gram + 1} to {gram + 200}")
    found = [_anchors(
        data[i : i + PIECE_BYTES], _rows(off, i, min(i + PIECE_BYTES, len(data))), i, width, gram,
    ) for i in range(0, max(len(data) - width + 1, 0), PIECE_BYTES - width + 1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _rows(off: np.ndarray, i: int, j: int) -> np.ndarray:
    """The row of each byte from i to j."""
    a, b = int(np.searchsorted(off, i, "right")) - 1, int(np.searchsorted(off, j))
    return np.repeat(np.arange(a, b, dtype=np.int32), np.diff(np.clip(off[a : b + 1], i, j)))


#: Multipliers of the words of a gram's hash.
_WORDS = np.random.default_rng(20250107).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anchors(data: np.ndarray, row: np.ndarray, base: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data) - gram + 1
    at = np.flatnonzero(row[: len(data) - width + 1] == row[width - 1 :])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    word = c.lanes(data)
    h = np.zeros(n, np.uint64)
    for k, i in enumerate(sorted({*range(0, gram - 7, 8), gram - 8})):
        h += word[i : n + i] * _WORDS[k]
    del word
    h = c.mix(h)
    b = _sliding_min(((h >> _PLACE) << _PLACE) | np.arange(n, dtype=np.uint64), width - gram + 1)[at]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (row[at[1:]] != row[at[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(b)) - 1
    place = (b[heads] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    # minima crowd at the low end, so another hash of the same bytes is listed
    name = (c.mix(h[place]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return name, row[at[heads]].astype(np.int64), at[heads] + base, at[tails] + base, place + base


def _bucket_count(rows: int, about: int, most: int) -> int:
    """Buckets for so many rows: of `about` rows each, then MOST_BUCKETS, then of `most` rows each."""
    return max(LEAST_BUCKETS, min(rows // about + 1, MOST_BUCKETS), rows // most + 1)


def _buckets(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes, the buckets present and where each begins (and, last, where all end)."""
    bucket = ((h >> (HASH_BITS - 32)) * buckets) >> 32
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.zeros(0, np.int64)
    return bucket[heads], np.append(heads, len(h))


def _pack(*arrays: np.ndarray, raw: bytes = b"") -> bytes:
    body = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays) + raw
    return len(arrays[0]).to_bytes(4, "little") + len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> tuple:
    n, body, out, at = int.from_bytes(blob[:4], "little"), _CODEC.decompress(blob[12:], int.from_bytes(blob[4:12], "little"), asbytes=True), [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(body[at : at + size], k))
        at += size
    return (*out, body[at:])


def _pack_rows(h: np.ndarray, row: np.ndarray, table: tuple[np.ndarray, ...], *more: np.ndarray, raw: bytes = b"") -> bytes:
    """Ascending hashes (as differences) with their texts, which are numbers into a table of (doc, key_a, key_b), and more columns."""
    rows, at = np.unique(row, return_inverse=True)
    head = _pack(*(x[rows] for x in table))
    return len(head).to_bytes(4, "little") + head + _pack(np.diff(h, prepend=0), at.astype("u4"), *more, raw=raw)


def _unpack_rows(blob: bytes, *kinds: str) -> tuple:
    """hash, doc, key_a, key_b, more columns, raw."""
    n = int.from_bytes(blob[:4], "little")
    doc, key_a, key_b, _ = _unpack(blob[4 : 4 + n], "i8", "i8", "i8")
    h, at, *more = _unpack(blob[4 + n :], "i8", "u4", *kinds)
    return np.cumsum(h), doc[at], key_a[at], key_b[at], *more


_CUT = ("i4", "u1", "u1")


def _unpack_cuts(blob: bytes) -> tuple:
    """hash, doc, key_a, key_b, first window start in the text, places from there to the anchor and to the last start, raw."""
    *cols, first, before, more, raw = _unpack_rows(blob, *_CUT)
    return *cols, first.astype(np.int64), before.astype(np.int64), more.astype(np.int64), raw


def _cutting_hashes(text: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray, before: np.ndarray, limit: int = 1 << 19) -> np.ndarray:
    """Hashes of cuttings with their anchor's hash and place; the text is taken in pieces."""
    out, i = np.empty(len(at), np.uint64), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit)))
        a, b = at[i], int((at[i:j] + size[i:j]).max())
        out[i:j] = c.span_hashes(text[a:b], at[i:j] - a, at[i:j] + size[i:j] - a)
        i = j
    return out ^ c.mix(h.astype(np.uint64) ^ c.mix(before.astype(np.uint64)))


def _same_texts(text: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers that are equal for cuttings of equal bytes, anchor and place of it, and for no others: hashes, checked by bytes."""
    same, salt = _cutting_hashes(text, at, size, h, before), 0
    while True:
        order = np.argsort(same, kind="stable")
        a, b = order[:-1], order[1:]
        hit = same[a] == same[b]
        a, b = a[hit], b[hit]
        wrong = ~((h[a] == h[b]) & (before[a] == before[b]) & c.equal_spans(text, at[a], text, at[b], size[a], size[b]))
        if not wrong.any():
            return same
        salt += 1
        for i in np.flatnonzero(np.isin(same, same[b[wrong]])):
            told = b"%d %d " % (h[i], before[i]) + text[at[i] : at[i] + size[i]].tobytes()
            same[i] = int.from_bytes(hashlib.blake2b(told, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")


def _keys(text) -> tuple:
    """key_a, key_b: 120 bits of a text's SHA-256."""
    sha = F.sha2(text, 256)
    return tuple(F.conv(F.substring(sha, i, 15), 16, 10).cast("long").alias(name) for name, i in (("key_a", 1), ("key_b", 16)))


def _marked(docs: DataFrame) -> DataFrame:
    """doc (never null), key_a, key_b (of the text), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), *_keys(text), text.alias("text"))


def _chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int):
    """Rows gathered to shards: tables with the bytes and offsets of their texts."""
    held, size = [], 0

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        return table, *c.utf8(table.column(column))

    for batch in batches:
        data, off = c.utf8(batch.column(column))
        for i, j in c.chunks(off, limit):
            if held and size + off[j] - off[i] > limit:
                yield whole()
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += off[j] - off[i]
    if held:
        yield whole()


def _table(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(n).to_numpy() for n in ("doc", "key_a", "key_b"))


def _list_anchors(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """bucket, settled, blob: anchors that one document of a shard has, and (settled) those shared within the shard.

    rows: doc, key_a, key_b, text."""

    def run(batches):
        for table, data, off in _chunks(batches, 3, SHARD_BYTES):
            doc = table.column("doc").to_numpy()
            short = _short(table.column("key_a").to_numpy())
            h, row = anchors(data, off, width)[:2]
            if not len(h):
                continue
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
            h, row = h[once], row[once]
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h))))
            several = np.zeros(len(heads), bool)
            several[group[1:][(h[1:] == h[:-1]) & (doc[row[1:]] != doc[row[:-1]])]] = True
            own = several[group]
            send = ~own
            send[heads] = True  # of shared ones, one tells the other shards
            hs, rs, told = h[send], row[send], own[send].astype("u1")
            present, edges = _buckets(hs, buckets)
            where = [(int(b), False) for b in present]
            out = [_pack_anchors(hs[i:j], rs[i:j], told[i:j], short) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            if own.any():  # any bucket will do for these
                where.append((int(h[0]) % buckets, True))
                out.append(_pack_anchors(h[own], row[own], np.zeros(int(own.sum()), "u1"), short))
            yield _blobs(where, out)

    return rows.mapInArrow(run, _BLOBS)


_BLOBS = "bucket int, settled boolean, blob binary"


def _blobs(where: list[tuple[int, bool]], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in where], pa.int32()), pa.array([k for _, k in where], pa.bool_()), pa.array(blobs, pa.binary())],
        names=["bucket", "settled", "blob"],
    )


#: Bits of a text's key by which anchors name it. Texts of one name get one another's anchors as well, which costs work and nothing else.
NAME_BITS = 40


def _short(key_a: np.ndarray) -> np.ndarray:
    return key_a & ((1 << NAME_BITS) - 1)


def _pack_anchors(h: np.ndarray, row: np.ndarray, told: np.ndarray, short: np.ndarray) -> bytes:
    """Ascending hashes (as differences), marks, and texts, which are numbers into a table of names (5 bytes each)."""
    rows, at = np.unique(row, return_inverse=True)
    names = short[rows].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : NAME_BITS // 8].tobytes()
    head = len(rows).to_bytes(4, "little") + names
    return len(head).to_bytes(4, "little") + head + _pack(np.diff(h, prepend=0).astype("<i8"), at.astype("u2" if len(rows) <= 65_536 else "u4"), told)


def _unpack_anchors(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, name, mark."""
    size, many = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    names = np.zeros((many, 8), np.uint8)
    names[:, : NAME_BITS // 8] = np.frombuffer(blob[8 : 4 + size], np.uint8).reshape(many, -1)
    h, at, told, _ = _unpack(blob[4 + size :], "<i8", "u2" if many <= 65_536 else "u4", "u1")
    return np.cumsum(h), names.view("<i8").ravel()[at], told


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """(name, hash) of a bucket's anchors that two documents or more have."""
    parts = [_unpack_anchors(x) for x in pdf["blob"][~pdf["settled"]]]
    merged = np.sort(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]))
    out = [(name, h) for h, name, _ in map(_unpack_anchors, pdf["blob"][pdf["settled"]])]
    for h, name, told in parts:
        n = np.searchsorted(merged, h, "right") - np.searchsorted(merged, h, "left")
        ok = (n > 1) & (told == 0)
        if ok.any():
            out.append((name[ok], h[ok]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
    return pd.DataFrame(dict(zip(("name", "hash"), cols, strict=True)))


def _equal(same: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and document; in that order, the first of each hash, and those of the hash's smallest document."""
    order = np.lexsort((doc, same))
    s, d = same[order], doc[order]
    heads = np.ones(len(s), bool)
    heads[1:] = s[1:] != s[:-1]
    return order, heads, d == d[heads][np.cumsum(heads) - 1]


def _cuttings(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """bucket, settled, blob: cuttings around shared anchors, and (settled) ranges (key_a, key_b, start, stop) already found.

    rows: doc, key_a, key_b, text, hashes (array)."""

    def run(batches):
        for table, data, off in _chunks(batches, 3, SHARD_BYTES):
            names = _table(table)
            doc, key_a, key_b = names
            lists = table.column("hashes").combine_chunks()
            owner = np.repeat(np.arange(table.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            pair = lambda h, row: c.mix(h.astype(np.uint64) ^ c.mix(row.astype(np.uint64) + np.uint64(1)))
            wanted = np.sort(pair(lists.flatten().to_numpy(), owner))
            h, row, lo, hi, place = anchors(data, off, width)
            if not len(h) or not len(wanted):
                continue
            mine = pair(h, row)
            take = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            h, row, lo, before, more = h[take], row[take], lo[take], (place - lo)[take], (hi - lo)[take]
            first, size = lo - off[row], more + width
            by = np.argsort(lo, kind="stable")
            same = np.empty(len(lo), np.uint64)
            same[by] = _same_texts(data, lo[by], size[by], h[by], before[by])
            order, heads, least = _equal(same, doc[row])
            settled = order[~least]
            # another shard may have a smaller document: all places in the smallest go on, the text with the first of them
            send, copy = order[least], ~heads[least]
            by = np.argsort(h[send], kind="stable")
            send, copy = send[by], copy[by]
            present, edges = _buckets(h[send], buckets)
            raw, where, out = data.tobytes(), [(int(b), False) for b in present], []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                part, again = send[i:j], copy[i:j]
                one = part[~again]
                text = b"".join([raw[x:y] for x, y in zip(lo[one].tolist(), (lo[one] + size[one]).tolist(), strict=True)])
                cut = (first[part].astype("i4"), before[part].astype("u1"), more[part].astype("u1"))
                out.append(_pack_rows(h[part], row[part], names, *cut, raw=np.packbits(again).tobytes() + text))
            if len(settled):  # any bucket will do for these
                settled = settled[np.lexsort((first[settled], row[settled]))]
                where.append((int(h[0]) % buckets, True))
                out.append(_pack(key_a[row[settled]], key_b[row[settled]], first[settled], first[settled] + size[settled]))
            yield _blobs(where, out)

    return rows.mapInArrow(run, _BLOBS)


def _settle(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """key_a, key_b, start, stop of the ranges that cuttings of smaller documents cover."""
        found = [_unpack(x, "i8", "i8", "i8", "i8")[:4] for x in pdf["blob"][pdf["settled"]]]
        parts = [_unpack_cuts(x) for x in pdf["blob"][~pdf["settled"]]]
        if not parts:
            return _ranges(found)
        h, doc, key_a, key_b, first, before, more = (np.concatenate([p[i] for p in parts]) for i in range(7))
        marks = [(len(p[0]) + 7) // 8 for p in parts]  # bytes that tell which places have the text of the one before
        own = ~np.concatenate([np.unpackbits(np.frombuffer(p[7], np.uint8, n), count=len(p[0])).astype(bool) for p, n in zip(parts, marks, strict=True)])
        text = np.frombuffer(b"".join([p[7][n:] for p, n in zip(parts, marks, strict=True)]), np.uint8)
        del parts
        size = more + width
        text_of = np.cumsum(own) - 1
        at = np.cumsum(size[own]) - size[own]
        same = _same_texts(text, at, size[own], h[own], before[own])[text_of]
        at = at[text_of]
        order, heads, least = _equal(same, doc)
        gone = order[~least]
        found.append((key_a[gone], key_b[gone], first[gone], first[gone] + size[gone]))
        # cuttings that differ but have an anchor in common: one of each to the suffix array
        one = order[heads]
        by = np.argsort(h[one], kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], h[one[by]][1:] != h[one[by]][:-1])))
        count = np.diff(np.append(edge, len(by)))
        several = by[np.repeat(count > 1, count)]
        many = one[several]
        if len(many):
            # what a cutting loses, it loses at all its places in the smallest document
            places = order[least]
            edge = np.append(np.flatnonzero(heads[least]), len(places))
            skip, windows = _with_partners(text, at[many], before[many], more[many], doc[many], h[many], width)
            live = np.flatnonzero(windows > 0)
            several, many, skip, windows = several[live], many[live], skip[live], windows[live]
            for owner, begin, end in _by_suffixes(text, at[many] + skip, windows + width - 1, doc[many], h[many], width):
                a, b = edge[several[owner]], edge[several[owner] + 1]
                hit = np.repeat(np.arange(len(owner)), b - a)
                to = places[np.arange(len(hit)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
                found.append((key_a[to], key_b[to], first[to] + (skip[owner] + begin)[hit], first[to] + (skip[owner] + end)[hit]))
        return _ranges(found)

    return run


def _ranges(found: list[tuple]) -> pd.DataFrame:
    """key_a, key_b, start, stop; ranges of a text that meet or overlap become one."""
    key_a, key_b, start, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((start, key_b, key_a))
    key_a, key_b, start, stop = key_a[order], key_b[order], start[order], stop[order]
    if len(start):
        # the running maximum of the stops within a text
        new = np.concatenate(([True], (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])))
        group = np.cumsum(new) - 1
        span = int(stop.max()) + 1
        top = np.maximum.accumulate(stop + group * span) - group * span
        new[1:] |= start[1:] > top[:-1]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(start)) - 1
        key_a, key_b, start, stop = key_a[heads], key_b[heads], start[heads], top[tails]
    return pd.DataFrame({"key_a": key_a, "key_b": key_b, "start": start, "stop": stop})


def _with_partners(text, at, before, more, doc, h, width, gram=GRAM):
    """First window and number of windows of each cutting that can start in another document's cutting as well.

    A window that reaches `half` bytes or more to the left of its anchor holds those bytes, any other one the `width - gram - half`
    bytes to the right of it. So its equal has the same bytes on that side, and a side that one document has goes without loss."""
    half = (width - gram) // 2
    left, right = before >= half, before - more < half
    place = at + before
    split = np.maximum(before - half + 1, 0)  # the windows before this one reach so far to the left
    for side, a, b in ((left, place - half, place), (right, place + gram, place + width - half)):
        i = np.flatnonzero(side)
        key = c.span_hashes(text, a[i], b[i]) ^ c.mix(h[i].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))[: len(i)]
        if len(i):
            told = doc[i][order]
            alone = np.minimum.reduceat(told, heads) == np.maximum.reduceat(told, heads)
            side[i[order]] = ~np.repeat(alone, np.diff(np.append(heads, len(i))))
    skip = np.where(left, 0, split)
    return skip, np.where(right, more + 1, np.minimum(split, more + 1)) - skip


#: Cuttings whose texts make one suffix array.
SUFFIX_CUTTINGS = 8_000


def _by_suffixes(text, at, size, doc, h, width):
    """Cutting, start and stop in it, of the ranges that repeat strings of smaller documents."""
    out, i = [], 0
    while i < len(at):
        j = min(i + SUFFIX_CUTTINGS, len(at))
        while j < len(at) and h[j] == h[j - 1]:
            j += 1
        s, n = at[i:j], size[i:j]
        new = np.cumsum(n) - n
        part = text[np.arange(n.sum()) + np.repeat(s - new, n)]
        windows = n - width + 1
        head = np.cumsum(windows) - windows
        starts = np.arange(windows.sum()) + np.repeat(new - head, windows)
        owner = np.repeat(np.arange(j - i), windows)
        hit = repeated_starts(part, doc[i:j][owner], starts, width)
        place = starts - new[owner]
        o, p = owner[hit], place[hit]
        if len(o):
            begin = np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)))
            end = np.append(begin[1:], True)
            out.append((i + o[begin], p[begin], p[end] + width))
        i = j
    return out


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_KEY = ["key_a", "key_b"]


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key_a, key_b (of the text), start, stop: ranges, maybe overlapping, that repeat strings of smaller documents.

    docs: doc, key_a, key_b, text, one row of each text (or rows that are equal)."""
    spark = docs.sparkSession
    c.small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    listed = _list_anchors(docs, _bucket_count(total * 2 // (width - GRAM + 2), *BUCKET_ANCHORS), width)
    anchors_ = listed.groupBy("bucket").applyInPandas(_merge, "name long, hash long")
    shared = c.stage(anchors_.groupBy("name").agg(F.collect_set("hash").alias("hashes")), "shared-anchors")
    called = docs.withColumn("name", F.col("key_a").bitwiseAND(F.lit((1 << NAME_BITS) - 1)))
    joined = c.join_checked(called, shared.select("name"), ["name"], "left_semi").join(shared, "name").select("doc", *_KEY, "text", "hashes")
    cuttings = shared.agg(F.sum(F.size("hashes"))).first()[0] or 0
    cut = _cuttings(joined, _bucket_count(cuttings, *BUCKET_CUTTINGS), width)
    return cut.groupBy("bucket").applyInPandas(_settle(width), "key_a long, key_b long, start long, stop long")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key_a, key_b, removed, spans, sha of what is left, from key_a, key_b, text, ranges."""
    for batch in batches:
        removed, spans, left_sha = [], [], []
        for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw, left, at, gone = text.encode(), hashlib.sha256(), 0, merge_ranges([(r["start"], r["stop"]) for r in ranges])
            for a, b in gone:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            removed.append(sum(b - a for a, b in gone))
            spans.append(len(gone))
            left_sha.append(left.hexdigest())
        cols = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left_sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[*_KEY, "removed", "spans", "left_sha"])


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), *_keys(text))
    base = c.stage(base.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))), "texts")
    several = base.groupBy("sha").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    several = c.stage(several.select("sha", "first"), "copies")
    known = c.join_checked(base, several, ["sha"], "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))
    copies = c.stage(known.where("copy").select("doc", *_KEY).distinct(), "copy-ids")
    unique = c.join_checked(_marked(docs).where(F.octet_length("text") >= width), copies, ["doc", *_KEY], "left_anti").select("doc", *_KEY, "text")
    ranges = repeated_spans(unique, width).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = c.stage(ranges, "ranges")
    touched = c.join_checked(unique, ranges.select(*_KEY), _KEY, "left_semi").dropDuplicates(_KEY)
    cut = (
        touched.join(ranges, _KEY).select(*_KEY, "text", "ranges")
        .mapInArrow(_left, "key_a long, key_b long, removed long, spans long, left_sha string")
    )
    cut = c.stage(cut, "cut-texts")
    whole = F.col("copy") & (F.col("n_bytes") >= width)
    return c.join_checked(known, cut, _KEY, "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(F.col("copy"), F.lit(0)).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(F.col("copy"), F.lit(0)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(_EMPTY_SHA)).when(F.col("copy"), F.col("sha")).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )
