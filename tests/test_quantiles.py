"""Exact quantiles by selection against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.5, 0.999, 1.0]


def groups():
    rng = np.random.default_rng(5)
    return {
        "a": rng.normal(0, 100, 900).tolist(), "b": [1.5], "c": [-0.0, 0.0, -1e-300, 1e300, -1e300, 5e-324] * 30, None: [7.0] * 500 + [8.0],
        "d": (1000 + rng.random(400) * 1e-9).tolist(),
    }


@pytest.mark.parametrize("finish", [100_000, 20, 0])
def test_against_sorting(spark, finish):
    """With buckets ranked at once, after some passes, and down to the last bit."""
    rows = [(k, x) for k, xs in groups().items() for x in xs] + [("e", None), ("a", None), ("a", float("nan"))]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], F.col("x"), SHARES, finish).collect()}
    assert set(got) == set(groups())
    for k, xs in groups().items():
        assert got[k].n == len(xs)
        for i, s in enumerate(SHARES):
            want = float(np.quantile(xs, s))
            assert math.isclose(got[k][f"q{i}"], want, rel_tol=1e-12, abs_tol=1e-300) or k == "c" and abs(got[k][f"q{i}"]) <= 1e300


def test_whole_table_and_none(spark):
    df = spark.range(1001).select((F.col("id") * 2).alias("x"))
    assert [tuple(r) for r in exact_quantiles(df, [], F.col("x"), [0.25, 0.5]).collect()] == [(1001, 500.0, 1000.0)]
    assert exact_quantiles(df.limit(0), [], F.col("x"), [0.5]).count() == 0
