"""Blocks in balanced brackets after a marker, such as JSON in a script of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..cluster import small_batches

#: Bytes of texts that one pass takes at once (a longer text is a pass of its own).
PASS_BYTES = 1 << 18


def _find(data: np.ndarray, what: bytes) -> np.ndarray:
    """Places where a byte string begins; overlapping ones too."""
    n = len(data) - len(what) + 1
    if n <= 0 or not what:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:n] == what[0])
    for i, b in enumerate(what[1:], 1):
        at = at[data[at + i] == b]
    return at


def _quotes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of double quotes after an even run of backslashes (or none) in their row."""
    quotes, slashes = np.flatnonzero(data == 0x22), np.flatnonzero(data == 0x5C)
    if not len(quotes) or not len(slashes):
        return quotes
    opens_row = lambda at: off[np.searchsorted(off, at)] == at
    new = np.concatenate(([True], np.diff(slashes) != 1)) | opens_row(slashes)  # a run doesn't reach into the row before
    begin = np.maximum.accumulate(np.where(new, slashes, 0))
    last = np.maximum(np.searchsorted(slashes, quotes) - 1, 0)
    behind = (slashes[last] == quotes - 1) & ~opens_row(quotes)
    return quotes[~behind | ((quotes - begin[last]) % 2 == 0)]


def balanced_spans(data: np.ndarray, off: np.ndarray, marker: bytes, pair: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the blocks of all rows (bytes, offsets): from the first opening bracket at or after a marker to the one that closes it.

    Brackets inside double quotes don't count; a quote after an odd run of backslashes is none. Whether a place is inside quotes depends on where
    the block began: so there are two running depths, of the brackets behind an even and behind an odd number of quotes, and a block uses that of
    its start. It ends where that depth first returns to what it was: a search among the brackets of each depth, in order. A marker whose block
    does not end in its row gives none. Only quotes, backslashes, brackets and markers have numbers of their own, not every byte."""
    starts, opens = _find(data, marker), np.flatnonzero(data == pair[0])
    if not len(starts) or not len(opens):
        return (np.zeros(0, np.int64),) * 3
    rows = np.searchsorted(off, starts, side="right") - 1
    whole = starts + len(marker) <= off[rows + 1]
    starts, rows = starts[whole], rows[whole]
    at = np.searchsorted(opens, starts + len(marker))
    there = at < len(opens)
    starts, rows, at = starts[there], rows[there], opens[at[there]]
    inside = at < off[rows + 1]
    rows, at = rows[inside], at[inside]
    quotes = _quotes(data, off)
    places = np.flatnonzero((data == pair[0]) | (data == pair[1]))
    step = np.where(data[places] == pair[0], 1, -1)
    parity, own = np.searchsorted(quotes, places) % 2, np.searchsorted(quotes, at) % 2
    stops = np.full(len(at), -1)
    for p in (0, 1):
        mine, here = np.flatnonzero(own == p), places[parity == p]
        depth = np.cumsum(step[parity == p])
        falls = np.flatnonzero(step[parity == p] < 0)
        if not len(mine) or not len(falls):
            continue
        low, width = depth.min(), len(here) + 1
        keys = np.sort((depth[falls] - low) * width + falls)
        nth = np.searchsorted(here, at[mine])  # the opening bracket's own number
        back = depth[nth] - 1 - low
        first = np.searchsorted(keys, back * width + nth)
        hit = keys[np.minimum(first, len(keys) - 1)]
        end = here[hit % width]
        found = (first < len(keys)) & (back >= 0) & (hit // width == back) & (end < off[rows[mine] + 1])
        stops[mine[found]] = end[found] + 1
    ok = stops >= 0
    return rows[ok], at[ok], stops[ok]


def with_blocks(batches: Iterator[pa.RecordBatch], of: int, markers: dict[str, bytes], pair: bytes, size: int) -> Iterator[pa.RecordBatch]:
    """Batches with a column of blocks a marker, of texts in column `of`; in pieces of `size` bytes of text, read where they lie."""
    for b in batches:
        texts = b.column(of).cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
            part, rows = data[off[i] : off[j]], b.slice(i, j - i)
            known, made = texts[i:j].is_valid().to_pylist(), []
            for marker in markers.values():
                blocks: list[list[str] | None] = [[] if k else None for k in known]
                for row, start, stop in zip(*balanced_spans(part, off[i : j + 1] - off[i], marker, pair), strict=True):
                    if known[row]:
                        blocks[row].append(part[start:stop].tobytes().decode())
                made.append(pa.array(blocks, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*b.schema.names, *markers])
            i = j


def balanced(df: DataFrame, text: str, marker: str | dict[str, str], pair: str = "{}") -> DataFrame:
    """df with `blocks`: the blocks of a text column, an array of strings in the order of their markers; null for a null text.

    Several markers, by the names of their columns, are found in one pass."""
    small_batches(df.sparkSession)
    of, ends, size = df.columns.index(text), pair.encode(), PASS_BYTES
    marks = {name: m.encode() for name, m in (marker if isinstance(marker, dict) else {"blocks": marker}).items()}
    blocks = [T.StructField(name, T.ArrayType(T.StringType())) for name in marks]
    return df.mapInArrow(lambda batches: with_blocks(batches, of, marks, ends, size), T.StructType([*df.schema.fields, *blocks]))
