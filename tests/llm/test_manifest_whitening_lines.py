"""Merkle manifest, whitening and line dedup against plain loops, and their defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import line_dedup, merkle, whitening

# --- line dedup ---------------------------------------------------------------------------------

LONG = [f"line {i} of a passage that many of the documents share, {'x' * i}" for i in range(40)]
LINES = "doc_id long, text string, `a.b` string, row string, places int, c0 string, hash string"


def line_frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "r", 7, "c", "h") for i, t in rows], LINES)


def keys_of(t):
    return [x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}) for x in (t or "").split("\n")]


def plain_lines(rows, min_chars=40, min_docs=5):
    seen = {}
    for n, (i, t) in enumerate(rows):
        for k in set(keys_of(t)):
            if len(k) >= min_chars:
                seen.setdefault(k, []).append((i is not None, i or 0))
    out = []
    for i, t in rows:
        gone = [len(seen.get(k, ())) >= min_docs and (i is not None, i or 0) != max(seen[k]) for k in keys_of(t)]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g)
        out.append((i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def line_rows():
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice((LONG[rng.randrange(40)], f"own line {rng.random()} " * 3, "short", "", " \t", LONG[0].upper() + " \r"))
                          for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(None, LONG[0]), (None, None), (99, ""), (98, "\n"), (97, LONG[0] + "\n" + LONG[0]), (97, LONG[0]), (97, LONG[0]), (7, LONG[0] + "\n" * 5)]
    return rows + [(200, "\n".join([LONG[1]] * 20_000 + ["é" * 39, "漢" * 40])), *((300 + i, "漢" * 40 + "\n" + "é" * 39) for i in range(6))]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("options", [{}, {"limit": 0}, {"limit": 0, "share": 0.05}])
def test_lines_against_a_loop(spark, options):
    """By broadcast, by shuffle, and with frequent hashes apart."""
    rows = line_rows()
    got = line_dedup.line_counts(line_frame(spark, rows), **options).collect()
    assert by_id(map(tuple, got)) == by_id(r[:4] for r in plain_lines(rows))
    assert sum(r.n_dropped for r in got) > 100


def test_texts_without_lines(spark):
    rows = line_rows()
    docs = line_frame(spark, rows)
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    got = got.collect()
    assert by_id((r.doc_id, r.text or "") for r in got) == by_id((r[0], r[4]) for r in plain_lines(rows))
    assert {tuple(r)[2:] for r in got} == {("d", "r", 7, "c", "h")} and sum(r.text is None for r in got) == 1


def test_threshold_of_documents_and_characters(spark):
    four = [(i, "y" * 40) for i in range(4)] + [(4, "y" * 39)]
    assert {r.n_dropped for r in line_dedup.line_counts(line_frame(spark, four)).collect()} == {0}
    five = [(i, "Y" * 40 + " ") for i in range(5)]
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.line_counts(line_frame(spark, five)).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    nulls = [(None, "y" * 40)] * 6
    assert {r.n_dropped for r in line_dedup.line_counts(line_frame(spark, nulls)).collect()} == {0}
    assert line_dedup.line_counts(line_frame(spark, [])).count() == 0 and line_dedup.drop_lines(line_frame(spark, [])).count() == 0


# --- Merkle manifest ----------------------------------------------------------------------------

LEAVES = "doc_id long, source string, lang string, n_chars long, text string, node string, place int, size string, block string"


def h(*a):
    return hashlib.sha256("".join(a).encode()).hexdigest()


def plain_leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = range(i // 2 * 2, min(i // 2 * 2 + 2, len(nodes)))
        out.append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        i //= 2
    return out


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {g: sorted(((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in rows if r[2] == g), key=lambda t: t[:3]) for g in langs}
    trees = {g: plain_tree([t[2] for t in by[g]]) for g in langs}
    top, out = plain_tree([trees[g][-1][0] for g in langs]), []
    for j, g in enumerate(langs):
        for i, (*_, leaf, r) in enumerate(by[g]):
            path = plain_path(trees[g], i) + plain_path(top, j)
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = plain_leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf
            for left, right in path:
                x = h(*left, x, *right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*(s for left, right in path for s in left + right)), x, x == top[-1][0]))
    return out


MANY = [(i * 3 % 101, "s", ("de", "en", None, "é", "zz")[i % 5 if i < 60 else 1], i, f"text {i}") for i in range(101)]
ODD = [
    (1, None, None, 3, "abc"), (None, "s", "en", None, None), (2, "s", "en", 0, ""), (2, "s", "en", 0, ""), (2, "s", "en", 1, "é漢"),
    (7, "s", "fr", 5, "word " * 40_000), (-9223372036854775808, "s", "en", -1, "x"), (9223372036854775807, "s", "en", 1, "x"),
]


@pytest.mark.parametrize(
    ("rows", "step"), [(MANY, 3), (MANY, 8), (ODD + ODD[2:3] * 40, 2), (ODD[:1], 8), ([], 8), ([(i, "s", str(i), i, "t") for i in range(5)], 1)],
)
def test_manifest_against_a_loop(spark, rows, step):
    docs = spark.createDataFrame([(*r, "n", 1, "b", "c") for r in rows], LEAVES)
    got = merkle.manifest(docs, step=step).collect()
    assert by_id(map(tuple, got)) == by_id(plain_manifest(rows))


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(*r, "n", 1, "b", "c") for r in MANY], LEAVES)
    assert all(r.verified for r in merkle.manifest(docs, forged=F.col("n_chars")).collect())
    got = merkle.manifest(docs, forged=F.when(F.col("doc_id") == 5, F.lit(0)).otherwise(F.col("n_chars"))).collect()
    assert [r.doc_id for r in got if not r.verified] == [5]


def test_a_task_holds_a_subtree_only(spark):
    """Written levels shrink by 2^step, and each group of rows has 2^step members at most."""
    leaves = spark.range(1000).select(
        F.lit(0).alias("whole"), F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("node"), F.lit(1000).cast("long").alias("size"),
    )
    tree = merkle.Tree(leaves, "whole", 3)
    assert [x.count() for x in tree.levels] == [1000, 125, 16, 2, 1]
    assert tree.tops().first().node == plain_tree([h(str(i)) for i in range(1000)])[-1][0]


# --- whitening ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "n", "c") for i, v in rows], VECTORS)


def plain_whitening(rows, k=16):
    told = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    x = np.array([v for _, v in told])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    y = u - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / np.trace(y.T @ y / n)


def matrix_of(got, column, k):
    return np.array([r[column] for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(-1, k)


@pytest.mark.parametrize(("d", "m", "k"), [(6, 200, 6), (24, 300, 16), (3, 50, 3)])
def test_whitening_against_eigh(spark, d, m, k):
    rng = np.random.default_rng(d)
    rows = [(i, (v * np.linspace(1, 3, d)).tolist()) for i, v in enumerate(rng.standard_normal((m, d)))]
    rows += [(m + i, rows[0][1]) for i in range(m // 2)]  # copies weigh once
    got = whitening.whiten(vector_frame(spark, rows)).collect()
    n, deviation, whitened, explained = plain_whitening(rows, k)
    assert {r.n for r in got} == {n} and len(got) == len(rows) * k
    assert (matrix_of(got, "deviation", k)[:, 0] == deviation).all()
    np.testing.assert_allclose(matrix_of(got, "explained", k)[0], explained, rtol=1e-10)
    w = matrix_of(got, "whitened", k)
    for c in range(k):
        assert min(np.abs(w[:, c] - whitened[:, c]).max(), np.abs(w[:, c] + whitened[:, c]).max()) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.0, 0.5]), (2, [3.0, -1.0])]
    bad = [(3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, -inf]), (8, []), (9, [1.0]), (10, [1.0, 3e38])]
    got = whitening.whiten(vector_frame(spark, good + bad)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in got} == {3}
    assert whitening.whiten(vector_frame(spark, bad[:3])).count() == 0 and whitening.whiten(vector_frame(spark, [])).count() == 0
    assert whitening.whiten(vector_frame(spark, good[:1] * 3)).count() == 0  # no variance


def test_equal_and_missing_deviations(spark):
    """Equal eigenvalues are all found; directions without variance give no component."""
    corners = [(i, [4.0 * (i >> j & 1) for j in range(3)] + [0.0, 0.0]) for i in range(8)]
    got = whitening.whiten(vector_frame(spark, corners)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(abs(r.explained - 1 / 3) < 1e-12 for r in got) and got[0].identity_error < 1e-10


def test_steps_end_when_the_components_are_found(spark):
    """Longer rows than WHOLE stop early, at the same result."""
    rng = np.random.default_rng(3)
    d, m = 160, 400
    scale = np.concatenate((np.linspace(40, 20, 4), np.full(d - 4, 0.5)))
    x = np.floor(64 * rng.standard_normal((m, d)) * scale).astype(int)
    means = x.sum(axis=0) / m
    rows = whitening.Rows(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"), means)
    calls, plain_sum = [], rows.sum
    rows.sum = lambda size, of: calls.append(size) or plain_sum(size, of)
    vectors, values = whitening.bidiagonalise(rows, 3)
    want = np.linalg.svd(x - means, full_matrices=False)
    np.testing.assert_allclose(values, want[1][:3], rtol=1e-12)
    assert np.abs(np.abs((want[2][:3] @ vectors).diagonal()) - 1).max() < 1e-12 and len(calls) < 100


def test_many_partial_sums_are_merged_in_groups(spark):
    fit = spark.range(0, 700, 1, 70).select(F.array(F.col("id"), F.col("id") * 2).alias("x"))
    rows = whitening.Rows(fit, np.array([1.0, 2.0]))
    assert rows.many and np.allclose(rows.sum(2, lambda x: x.sum(axis=0)), [699 * 350 - 700, 2 * 699 * 350 - 1400])


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40, 0]])
    assert whitening.deviations(x, 10, [0, 0]) == [None] and whitening.deviations(np.array([[3, 4]]), 10, [1, 2]) == [29**2 + 38**2]
