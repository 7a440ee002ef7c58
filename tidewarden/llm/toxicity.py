"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding: compatibility forms, lower case, look-alike letters of other scripts to Latin, digit and sign substitutions to the
letters they stand for (l, 1 and i are one letter), invisible characters dropped, other signs to spaces. The lexicon is
learned from labelled documents: beginnings of words (4 to 12 letters) and whole words, weighted by the log odds of
documents with label 1 against label 0. A beginning gives way to a longer one that holds nearly all its documents,
and then stands for all longer ones. Exception phrases are pairs of words around a term that clean documents repeat
and toxic ones lack; a term within one does not count. A document's evidence is the sum of the weights
of its hits, and that sum to its number of words; a logistic function of the two is its score.

Bounds (documented, of the training sample only): TOXIC_ROWS and CLEAN_ROWS labelled doc_ids, the first by hash. The vocabulary is
what that sample yields, without a limit of its own. Scoring covers all documents and whole texts.

Defined cases: null and empty texts have no evidence and get the score of none; repeated rows are scored each; a null
doc_id is not held out and has no label; repeated labels of one doc_id count as the largest; null labels don't count;
without labels of both kinds every score is 0; an empty table gives an empty result; other columns are never read."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

TOXIC_ROWS = 3_000
CLEAN_ROWS = 6_000
#: Toxic documents that must hold a term, their least share of the sample's, and the least odds of label 1 against label 0.
LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.01
LEAST_ODDS = 20.0
LONGEST = 12

#: Look-alikes and substitutions. Letters on the left of a pair are read as the one on the right.
LOOK_ALIKES = (
    ("аαａ", "a"), ("еεё", "e"), ("оοσ", "o"), ("рρ", "p"), ("сϲ", "c"), ("хχ", "x"), ("уγ", "y"), ("ѕ", "s"), ("јϳ", "j"), ("кκ", "k"),
    ("мμ", "m"), ("тτ", "t"), ("вβ", "b"), ("нη", "h"), ("іιıї", "i"), ("ν", "v"), ("υ", "u"), ("ԁ", "d"), ("ɡ", "g"), ("ո", "n"), ("ѡω", "w"),
)
SUBSTITUTIONS = (("0", "o"), ("1l", "i"), ("3", "e"), ("4@", "a"), ("5$", "s"), ("7", "t"), ("8", "b"), ("9", "g"))
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {code: " " for code in range(128) if not chr(code).isalnum()}
_FOLD |= {ord(x): to for many, to in (*LOOK_ALIKES, *SUBSTITUTIONS) for x in many}
_FOLD |= {ord(x): None for x in INVISIBLE}
_FOLD |= {ord(x): " " for x in "«»“”‘’„…–—¿¡·•"}


def fold(text: str | None) -> str:
    """The text's folded words with single spaces between them and around all."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = text.lower().translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


def beginnings(folded: str) -> set[str]:
    """Beginnings of words and whole words, with the spaces that bound them."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(len(w), LONGEST) + 1))
    return out


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    #: bias, weight of log1p(sum), weight of log1p(100 * sum / (words + 20))
    model: tuple[float, ...] = field(default=())


class Matcher:
    """The automaton of a lexicon's terms and exception phrases; built once a task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for t, weight in lexicon.terms:
            self.found.add_word(t, (len(t), weight, False))
        for e in lexicon.exceptions:
            self.found.add_word(e, (len(e), self.found.get(e, (0, 0.0, False))[1], True))
        if len(self.found):
            self.found.make_automaton()

    def hits(self, folded: str) -> Iterator[tuple[int, int, float, bool]]:
        """First and last place, weight, whether an exception, of each match."""
        if len(self.found):
            for end, (size, weight, exempt) in self.found.iter(folded):
                yield end - size + 1, end, weight, exempt

    def evidence(self, folded: str) -> tuple[float, int]:
        """Sum of the weights of hits outside exception phrases, and the number of words."""
        total, spared = [], []
        for a, b, weight, exempt in self.hits(folded):
            if exempt:
                spared.append((a, b))
            if weight:
                total.append((a, weight))
        if spared:
            inside = bytearray(len(folded))
            for a, b in spared:
                inside[a:b] = b"\1" * (b - a)
            total = [x for x in total if not inside[x[0]]]
        return sum(w for _, w in total), max(folded.count(" ") - 1, 0)


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], 1)


def remainder(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the training sample: rows whose remainder isn't 0, TOXIC_ROWS and CLEAN_ROWS at most."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic is not null and doc_id is not null")
    )
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder() != 0).join(there, "doc_id", "left_semi")
    first = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = c.stage(first(1, TOXIC_ROWS).unionByName(first(0, CLEAN_ROWS)), "labelled")
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _count(rows: DataFrame, make) -> DataFrame:
    """what, toxic, clean: documents of either label in whose folded text `make()` finds what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of = (Counter(), Counter()), make()
        for batch in batches:
            for text, toxic in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found[1 - toxic].update(of(fold(text)))
        names = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_pydict({
            "what": pa.array(names, pa.string()), "toxic": pa.array([found[0][n] for n in names], pa.int64()),
            "clean": pa.array([found[1][n] for n in names], pa.int64())
        })

    return (
        rows.mapInArrow(run, "what string, toxic long, clean long").groupBy("what").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """Terms and weights from (beginning, toxic, clean) counts."""
    odds = {w: np.log((t + 0.5) / (n_toxic + 1)) - np.log((k + 0.5) / (n_clean + 1)) for w, t, k in counts}
    toxic = {w: t for w, t, _ in counts}
    good = {w for w in odds if odds[w] >= np.log(LEAST_ODDS)}
    longer = {}
    for w in good:
        short = w[:-1]
        longer[short] = max(longer.get(short, 0), toxic[w])
    kept: dict[str, float] = {}
    for w in sorted(good, key=lambda w: (len(w), w)):
        if longer.get(w, 0) >= 0.999 * toxic[w] or any(w[:n] in kept for n in range(5, len(w))):
            continue
        kept[w] = float(odds[w])
    return sorted(kept.items(), key=lambda x: (-x[1] * toxic[x[0]], x[0]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w * ([0] + [1] * (len(w) - 1))
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, exceptions and score of the labelled training sample."""
    c.small_batches(docs.sparkSession)
    rows = c.stage(labelled(docs, labels), "training-texts")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    least = min(n_toxic, max(LEAST_DOCUMENTS, int(LEAST_SHARE * n_toxic)))
    often = _count(rows.where("toxic = 1"), lambda: beginnings).where(F.col("toxic") >= least)
    names = frozenset(r.what for r in often.collect())
    counts = _count(rows, lambda: lambda folded: beginnings(folded) & names).collect()
    terms = choose_terms([(r.what, r.toxic, r.clean) for r in counts], n_toxic, n_clean)
    lexicon = Lexicon(tuple(terms))

    def phrases():
        matcher = Matcher(lexicon)

        def of(folded: str) -> set[str]:
            out, words = set(), folded.split()
            at = {m[0] for m in matcher.hits(folded)}
            place = 0
            for i, w in enumerate(words):
                if place in at:
                    out.update(f" {a} {b} " for a, b in ((words[i - 1], w) if i else (None, w), (w, words[i + 1]) if i + 1 < len(words) else (w, None)) if a and b)
                place += len(w) + 1
            return out

        return of

    spared = _count(rows, phrases).where("toxic = 0 and clean >= 3") if terms else None
    lexicon = Lexicon(lexicon.terms, tuple(sorted(r.what for r in spared.collect())) if spared is not None else ())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            got = [matcher.evidence(fold(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(1)],
                names=["total", "words", "toxic"],
            )

    seen = rows.mapInArrow(summed, "total double, words long, toxic int").toPandas().sort_values(["total", "words", "toxic"])  # bounded by the sample
    w = _logistic(features(seen["total"].to_numpy(), seen["words"].to_numpy()), seen["toxic"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.exceptions, tuple(float(x) for x in w))


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, evidence of every document."""
    c.small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(lexicon)  # the vocabulary of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        matcher = Matcher(known)
        for batch in batches:
            got = [matcher.evidence(fold(x)) for x in batch.column(1).to_pylist()]
            total, words = np.array([g[0] for g in got], float), np.array([g[1] for g in got], np.int64)
            score = 1 / (1 + np.exp(-(features(total, words) @ np.array(known.model)))) if known.model else np.zeros(len(got))
            cols = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(words), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "n_words", "evidence"])

    held = F.coalesce(remainder() == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), "text", held)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_words long, evidence double")
