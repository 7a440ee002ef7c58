"""Quality rules as a short-circuit cascade.

Each rule's cost (CPU seconds a document) and selectivity (share of documents it rejects) are measured
on a bounded sample; rules then run in the order of rejections per cost, each only on the documents that
all rules before it have passed. The verdict does not depend on the order.

Defined cases: null or empty text has no words and fails; repeated doc_ids are judged row by row; an
empty table gives an empty result; other columns of the input are carried through by `filter_documents`
and ignored by `score_documents`."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Documents in the sample that orders the rules.
SAMPLE_ROWS = 2_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Texts:
    """Texts of a chunk of documents with the features that rules ask for, each computed when first used."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self._made = data, off, {}

    def _once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def rows(self, keep: np.ndarray) -> Texts:
        """Only the rows where keep is set, with what is known of their words."""
        sizes = np.diff(self.off)
        new = np.concatenate(([0], np.cumsum(sizes[keep])))
        out = Texts(self.data[np.repeat(keep, sizes)], new)
        if "spans" in self._made:
            starts, ends, counts = self.spans
            here = np.repeat(keep, counts)
            moved = np.repeat(self.off[:-1][keep] - new[:-1], counts[keep])
            out._made["spans"] = starts[here] - moved, ends[here] - moved, counts[keep]
        return out

    @property
    def spans(self):
        return self._once("spans", lambda: c.word_spans(self.data, self.off))

    @property
    def n_words(self) -> np.ndarray:
        return self.spans[2]

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that neither continue a code point nor part words."""
        return self._once("chars", lambda: c.per_row(((self.data & 0xC0) != 0x80) & ~c.SPACE[self.data], self.off))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("symbols", lambda: c.per_row(_SYMBOL[self.data], self.off))

    @property
    def n_letters(self) -> np.ndarray:
        return self._once("letters", lambda: c.per_row(_LETTER[self.data] & ((self.data & 0xC0) != 0x80), self.off))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line of the row."""
        return self._once("lines", self._lines)

    def _lines(self):
        n = len(self.off) - 1
        if not len(self.data):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        breaks = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.off[:-1][np.diff(self.off) > 0], breaks + 1)
        rows = np.searchsorted(self.off, starts, "right") - 1
        ok = starts < len(self.data)
        starts, rows = starts[ok], rows[ok]
        stops = np.searchsorted(breaks, starts)
        ends = np.minimum(np.append(breaks, len(self.data))[stops], self.off[rows + 1])
        words = self.spans[0]
        has = np.searchsorted(words, ends) > np.searchsorted(words, starts)
        starts, ends, rows = starts[has], ends[has], rows[has]
        again = c.repeats(self.data, starts, ends, rows)
        return np.bincount(rows, minlength=n), np.bincount(rows[again], minlength=n)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words that a 3-word window found twice or more in its row covers."""
        return self._once("repeats", self._repeats)

    def _repeats(self):
        starts, ends, counts = self.spans
        n, rows = len(counts), np.repeat(np.arange(len(counts)), counts)
        grams = c.window_hashes(c.span_hashes(self.data, starts, ends), 3)
        if not len(grams):
            return np.zeros(n, np.int64)
        own = rows[: len(grams)]
        inside = np.flatnonzero(own == rows[2:])
        keys = c.mix(grams[inside] ^ c.mix(own[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        a, b = inside[order[:-1][same]], inside[order[1:][same]]
        size = ends - starts
        proved = own[a] == own[b]
        for i in range(3):  # hashes find candidates, bytes decide
            proved &= c.equal_spans(self.data, starts[a + i], self.data, starts[b + i], size[a + i], size[b + i])
        if not proved.all():  # different windows with one hash
            a = b = self._windows_twice(inside)
        covered = np.zeros(len(rows), bool)
        for i in range(3):
            covered[a + i] = covered[b + i] = True
        return np.bincount(rows[covered], minlength=n)

    def _windows_twice(self, inside: np.ndarray) -> np.ndarray:
        """The 3-word windows found twice or more in their row, by the words themselves."""
        starts, ends, counts = self.spans
        rows, by = np.repeat(np.arange(len(counts)), counts), {}
        words = [self.data[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i in inside.tolist():
            by.setdefault((rows[i], *words[i : i + 3]), []).append(i)
        return np.array([i for found in by.values() if len(found) > 1 for i in found], np.int64)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The rules and their thresholds. The first two are the base, the others the cascade's own.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_trigrams", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 100 * t.n_symbols > 30 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("few_letters", lambda t: 100 * t.n_letters < 50 * t.word_chars),
    Rule("duplicate_lines", lambda t: 100 * t.lines[1] > 40 * t.lines[0]),
)
BASE = ("few_words", "repeated_trigrams")


def cascade(texts: Texts, order: tuple[str, ...]) -> np.ndarray:
    """Numbers of the rows that pass all rules; a rule sees only rows that passed those before it."""
    by_name = {r.name: r for r in RULES}
    alive = np.arange(len(texts.off) - 1)
    for name in order:
        if not len(alive):
            break
        bad = by_name[name].rejects(texts)
        if bad.any():
            alive, texts = alive[~bad], texts.rows(~bad)
    return alive


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seconds, rejected, seen = dict.fromkeys((r.name for r in RULES), 0.0), dict.fromkeys((r.name for r in RULES), 0), 0
    for batch in batches:
        data, off = c.utf8(batch.column(0))
        for i, j in c.chunks(off):
            seen += j - i
            for r in RULES:
                fresh = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                began = time.thread_time()
                rejected[r.name] += int(r.rejects(fresh).sum())
                seconds[r.name] += time.thread_time() - began
    names = [r.name for r in RULES]
    yield pa.RecordBatch.from_pydict({
        "rule": names, "seconds": [seconds[n] for n in names], "rejected": [rejected[n] for n in names], "seen": [seen] * len(names),
    })


def rule_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[str, ...]:
    """Rule names by measured rejections per CPU second, most first, from a sample of about `sample_rows` documents."""
    c.small_batches(docs.sparkSession)
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=7)
    found = (
        sample.mapInArrow(_measure, "rule string, seconds double, rejected long, seen long")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen")).collect()
    )
    gain = {r.rule: (r.rejected + 0.5) / (r.seen + 1) / max(r.seconds / max(r.seen, 1), 1e-9) for r in found}
    return tuple(sorted((r.name for r in RULES), key=lambda n: (-gain.get(n, 0.0), n)))


def score_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts of every whole text, base_failed, and the cascade's verdict `kept`."""
    order = rule_order(docs, sample_rows)
    rest = tuple(n for n in order if n not in BASE)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = c.utf8(batch.column(1))
            for i, j in c.chunks(off):
                t = Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                failed = np.logical_or.reduce([r.rejects(t) for r in RULES if r.name in BASE])
                kept = np.zeros(j - i, bool)
                alive = np.flatnonzero(~failed)
                kept[alive[cascade(t.rows(~failed), rest)]] = True
                cols = [
                    batch.column(0).slice(i, j - i),
                    *(pa.array(x.astype(np.int64)) for x in (t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words)), pa.array(failed),
                    pa.array(kept),
                ]
                yield pa.RecordBatch.from_arrays(
                    cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    )


def filter_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order, at = rule_order(docs, sample_rows), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = c.utf8(batch.column(at))
            kept = np.zeros(len(off) - 1, bool)
            for i, j in c.chunks(off):
                kept[i + cascade(Texts(data[off[i] : off[j]], off[i : j + 1] - off[i]), order)] = True
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
