"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

A vector's entries c become integers x = floor(64 c) + 1000000. The fit list holds each distinct x vector once: a matrix X of n rows,
centred by its means. From a start vector v the bidiagonalisation alternates two distributed passes over the rows: Xv, less what
it has of the earlier left vectors, and X'u. Right vectors (as long as a row) and the small bidiagonal matrix live on the driver;
left vectors, as long as the table, are written nowhere: each is X times a short vector, so a pass regenerates its rows of all
of them with one product and returns only sums, and a lost executor costs the tasks it ran. Both sides are orthogonalised in full
against all earlier ones, twice. The singular value decomposition of the bidiagonal matrix gives components (X's right singular vectors)
and deviations; the steps end when the residuals of the components asked for are below TINY of the largest singular value, or
when the space is used up. A vector that leads nowhere (an invariant space, a direction without variance) is followed by a new
direction, orthogonal to those before.

Sums are taken of x - 1000000 and rows centred with those, so nothing is lost to the offset. The driver holds vectors of a row's
length, as many as there are steps; a pass sends it such a sum from each task, merged in two levels where tasks are many.

Defined cases: rows whose vector is null, or has a null or non-finite entry, or one whose x does not fit 52 bits, are dropped; so are vectors
of another length than the most frequent one (of equally frequent ones the longer), empty ones included. Null and repeated vec_ids and
repeated vectors are rows of the result; components without variance (1e-20 of the largest) are left out, so one distinct vector alone gives no
row. deviation is exact, null where it would exceed 64 bits. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Scale and offset of the integers, and the most components.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Residual of a singular triplet, as a share of the largest singular value, at which it counts as found.
TINY = 1e-15
#: Length, as a share of the longest Xv, that counts as none.
NOTHING = 1e-13
#: Rows up to this length are bidiagonalised whole, so that equal singular values are all met.
WHOLE = 128
#: Partial sums that go to the driver one by one; more are summed by groups first.
DIRECT = 64
_FIT = float(1 << 52)


def integer_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, x (x - OFFSET of each entry) of the rows that count, staged."""
    kind = dict(rows.dtypes)[vector]
    if not kind.startswith("array"):
        raise TypeError(f"{vector} is {kind}, not an array")
    wide = F.transform(F.col(vector), lambda e: e.cast("double") * SCALE)
    told = rows.select(F.col(key).cast("long").alias("vec_id"), wide.alias("y")).where("y is not null")
    sound = told.where(F.forall("y", lambda e: F.coalesce(F.abs(e) < _FIT, F.lit(False)) & ~F.isnan(F.coalesce(e, F.lit(0.0)))))
    sound = c.stage(sound.select("vec_id", F.transform("y", lambda e: F.floor(e)).alias("x")), "vectors")
    length = sound.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return sound.where(F.size("x") == (length["d"] if length else 0)).where(F.size("x") > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """n, and each dimension's sum and sum of squares, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, [0] * d, [0] * d
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            most = int(np.abs(x).max())
            if most * most * len(x) >= 1 << 62:
                x = x.astype(object)
            n += len(x)
            one = [a + int(s) for a, s in zip(one, x.sum(axis=0), strict=True)]
            two = [a + int(s) for a, s in zip(two, (x * x).sum(axis=0), strict=True)]
        if n:
            wide = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(one, wide), pa.array(two, wide)], names=["at", "n", "s", "q"],
            )

    parts = fit.select("x").mapInArrow(run, "at int, n long, s decimal(38,0), q decimal(38,0)")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("at").collect()  # a row a dimension
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got], [int(r["q"]) for r in got]


class Rows:
    """The centred rows of the fit list, for sums over all of them."""

    def __init__(self, fit: DataFrame, means: np.ndarray) -> None:
        self.fit, self.means = fit.select("x"), means
        self.many = fit.select(F.spark_partition_id().alias("part")).distinct().count() > DIRECT

    def sum(self, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of the `size` numbers that `of` makes of each block of rows."""
        means = self.means

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += of(_matrix(b.column(0)) - means)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

        def merged(table: pa.Table) -> pa.Table:
            return pa.table({"sum": [sum(np.frombuffer(x.as_py()) for x in table.column("sum")).tobytes()]})

        parts = self.fit.mapInArrow(run, "sum binary")
        if self.many:
            parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(DIRECT)).alias("part")).applyInArrow(merged, "sum binary")
        return sum((np.frombuffer(bytes(r["sum"])) for r in parts.collect()), np.zeros(size))  # DIRECT rows at most


@dataclass
class Fit:
    """Sums of the fit list, and its components."""

    n: int
    sums: list[int]  # of x - OFFSET
    trace: float  # of the covariance
    vectors: np.ndarray  # d x k, unit eigenvectors
    values: np.ndarray  # k, eigenvalues, falling
    rows: Rows


def _orthogonal(z: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in basis:
            z = z - (v @ z) * v
    return z


def bidiagonalise(rows: Rows, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (d x k, or fewer) and singular values of the centred rows, largest first."""
    d, rng = len(rows.means), np.random.default_rng(seed)
    v = [_unit(rng.standard_normal(d))]  # right vectors
    w: list[np.ndarray] = []  # the left vectors are X w,
    back: list[np.ndarray] = []  # and X'u of them
    alpha: list[float] = []
    beta: list[float] = []
    scale = 0.0
    while True:
        m, left = len(w), np.array(w).reshape(len(w), d).T

        def forth(x: np.ndarray, y: np.ndarray = v[-1], left: np.ndarray = left) -> np.ndarray:
            """Of a block: what Xy has of each left vector, and |Xy|^2."""
            p = x @ y
            return np.concatenate(((x @ left).T @ p, [p @ p]))

        first = rows.sum(m + 1, forth)
        scale = max(scale, float(np.sqrt(first[m])))
        y = v[-1] - left @ first[:m]

        def and_back(x: np.ndarray, y: np.ndarray = y, forth: Callable = forth) -> np.ndarray:
            """The same of what is left, and X' of it."""
            return np.concatenate((forth(x, y), x.T @ (x @ y)))

        second = rows.sum(m + 1 + d, and_back)
        rest, z = second[:m], second[m + 1 :]  # what rounding left of the earlier vectors comes off without another pass
        length = float(np.sqrt(max(second[m] - rest @ rest, 0.0)))
        if m:
            y, z = y - left @ rest, z - np.array(back).T @ rest
        if length <= NOTHING * scale:  # no variance this way
            length, u, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            u, image = y / length, z / length
        alpha.append(length)
        w.append(u)
        back.append(image)
        z = _orthogonal(image - length * v[-1], v)
        size = float(np.linalg.norm(z))
        p, s, qt = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        ends = size <= NOTHING * scale
        found = len(v) > k and d > WHOLE and not ends and bool((size * np.abs(p[-1, :k]) <= TINY * s[0]).all())
        if len(v) >= d or found:
            return np.array(v).T @ qt[:k].T, s[:k]
        beta.append(0.0 if ends else size)
        v.append(_unit(_orthogonal(rng.standard_normal(d), v) if ends else z))


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.linalg.norm(z)


def fit_components(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the distinct vectors; null without any vector."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    fit = c.stage(vectors.select("x").distinct(), "fit-list")
    n, sums, squares = _totals(fit, d)
    spread = sum(n * q - s * s for s, q in zip(sums, squares, strict=True))  # n^2 times the trace, exact
    rows = Rows(fit, np.array([s / n for s in sums]))
    if not spread:
        return Fit(n, sums, 0.0, np.zeros((d, 0)), np.zeros(0), rows)
    vecs, s = bidiagonalise(rows, min(components, d))
    keep = s * s > 1e-20 * s[0] * s[0]
    return Fit(n, sums, spread / n / n, vecs[:, keep], (s * s / n)[keep], rows)


def identity_error(fit: Fit) -> float:
    """The largest entry, by size, of the whitened fit list's covariance less the identity."""
    k = len(fit.values)
    turn = fit.vectors / np.sqrt(fit.values)

    def block(x: np.ndarray) -> np.ndarray:
        y = x @ turn
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    total = fit.rows.sum(k + k * k, block) / fit.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [o if o < 1 << 63 else None for o in out]


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = rows.sparkSession
    c.small_batches(spark)
    vectors = integer_vectors(rows, vector, key)
    fit = fit_components(vectors, components)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], _SCHEMA)
    error = identity_error(fit)
    k, n, sums, means = len(fit.values), fit.n, fit.sums, fit.rows.means
    turn, explained = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((x - means) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, _SCHEMA)
