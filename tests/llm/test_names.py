"""Rows and columns keep their identity: extreme doc_ids beside null ones, and column names that operators use or that hold dots."""

import pytest

from tests.llm.test_text_operators import BASE
from tidewarden.llm import exact_dedup, mixing, ngram_join, toxicity

NAMED = "doc_id long, text string, source string, `a.b` string, `row.c` int, digest string, doc string, stays string, keep_id long, several string, __digest string, c0 int, size int"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def named(spark, rows):
    return spark.createDataFrame([(i, t, "s", "d", 1, "g", "o", "y", 5, "v", "q", 7, 8) for i, t in rows], NAMED)


@pytest.mark.parametrize("keep", [exact_dedup.drop_copies, ngram_join.keep_one, mixing.mix_documents])
def test_columns_of_any_name(spark, keep):
    docs = named(spark, [(1, BASE), (2, BASE), (3, "other words of a text " * 3), (None, None)])
    got = keep(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert {tuple(r)[2:] for r in rows} == {("s", "d", 1, "g", "o", "y", 5, "v", "q", 7, 8)}
    if keep is not mixing.mix_documents:
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 3]


def test_extreme_ids_in_components(spark):
    near = BASE + " " + BASE.replace("one", "uno") + " tail words"
    rows = [(LEAST, near), (3, near + " x"), (None, near + " y"), (0, "short"), (None, "short"), (MOST, "alone in the world of texts")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(named(spark, rows)).collect()}
    assert {(i, c) for i, _, c in got} == {(LEAST, LEAST), (3, LEAST), (None, LEAST), (0, 0), (None, 0), (MOST, MOST)}
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_one(named(spark, rows)).collect()}
    assert kept == {(LEAST, near), (0, "short"), (MOST, rows[-1][1])}


def test_fit_counts_of_a_small_sample(spark):
    """The learned lexicon against counts of the whole sample by plain loops."""
    import numpy as np

    texts = [(i, f"pl{i % 7}in words number{i} " + ("villain scoundrel talk" if i % 4 == 0 else "kind talk") + (" nicely" if i % 3 else "")) for i in range(50)]
    docs = named(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    trained = {r.doc_id for r in labels.where(toxicity.remainder() != 0).collect()}
    toxic, clean = ([t for i, t in texts if i in trained and (i % 4 == 0) == bad] for bad in (True, False))
    lex = toxicity.fit(docs, labels)
    held = {w: tuple(sum(w in toxicity.beginnings(toxicity.fold(t)) for t in side) for side in (toxic, clean)) for w, _ in lex.terms}
    for w, weight in lex.terms:
        t, k = held[w]
        assert weight == pytest.approx(np.log((t + 0.5) / (len(toxic) + 1)) - np.log((k + 0.5) / (len(clean) + 1)))
    every = {w for t in toxic for w in toxicity.beginnings(toxicity.fold(t))}
    told = {w for w, _ in lex.terms}
    least = min(len(toxic), toxicity.LEAST_DOCUMENTS)
    for w in every:  # a term that is left out is rare, common among the clean, or stands for the same documents as another
        t, k = (sum(w in toxicity.beginnings(toxicity.fold(x)) for x in side) for side in (toxic, clean))
        odds = np.log((t + 0.5) / (len(toxic) + 1)) - np.log((k + 0.5) / (len(clean) + 1))
        if t >= least and odds >= np.log(toxicity.LEAST_ODDS) and w not in told:
            assert any(o.startswith(w) or w.startswith(o) for o in told), w
    assert all(any(toxicity.fold(word).startswith(w.rstrip()) for w in told) for word in ("villain", "scoundrel"))
