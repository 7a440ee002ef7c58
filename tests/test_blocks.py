"""Windows cut into blocks of time against plain loops over whole keys."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_windows import brute_sigma
from tidewarden.operators import blocks, jumps, windows

SCHEMA = "k string, hour long, x double, note string"


@pytest.fixture(scope="module")
def lines():
    """Keys with holes, with one row, with long pauses, and a null key."""
    rng = np.random.default_rng(17)
    out = {}
    for k, n, end in (("a", 200, 400), ("b", 1, 50), (None, 60, 90), ("c", 40, 4000)):
        times = sorted(rng.choice(end, n, replace=False).tolist())
        out[k] = [(t, None if rng.random() < 0.15 else float(rng.normal())) for t in times]
    return out


@pytest.fixture(scope="module")
def frame(spark, lines):
    return spark.createDataFrame([(k, t, x, "n") for k, rows in lines.items() for t, x in rows], SCHEMA).cache()


@pytest.mark.parametrize("unit", [7, 10_000])
def test_row_before(frame, lines, unit):
    """A row's predecessors come along however long ago they were."""
    def lagged(b, keys):
        w = Window.partitionBy(*keys).orderBy("hour")
        return b.withColumns({f"t{n}": F.lag("hour", n).over(w) for n in (1, 3)})

    out = blocks.dealt(frame, ["k"], "hour", 0, 3, lagged, unit=unit, span=1)
    assert out.columns == [*frame.columns, "t1", "t3"]
    got = {(r.k, r.hour): (r.t1, r.t3) for r in out.collect()}
    assert len(got) == out.count() == sum(map(len, lines.values()))
    for k, rows in lines.items():
        for i, (t, _) in enumerate(rows):
            assert got[(k, t)] == (rows[i - 1][0] if i else None, rows[i - 3][0] if i >= 3 else None)


@pytest.mark.parametrize("block", [7, 10_000])
def test_running_sums(frame, lines, block):
    got = {(r.k, r.hour): (r.n, r.s) for r in blocks.running(frame, ["k"], "hour", {"n": F.lit(1), "s": F.col("x")}, block).collect()}
    for k, rows in lines.items():
        for i, (t, _) in enumerate(rows):
            held = [y for _, y in rows[: i + 1] if y is not None]
            assert got[(k, t)] == (i + 1, pytest.approx(sum(held)) if held else None)


@pytest.mark.parametrize(("seconds", "unit", "wide"), [(30, 30, False), (3, 7, False), (1000, None, True)])
def test_mean_of_a_range(frame, lines, seconds, unit, wide):
    by = 1e12 if wide else 1
    mean = lambda b, keys: b.withColumn("m", windows.range_mean(F.col("x") * by, "hour", keys, seconds, 3, wide))
    got = {(r.k, r.hour): r.m for r in blocks.dealt(frame, ["k"], "hour", seconds, 1, mean, unit=unit).collect()}
    assert len(got) == sum(map(len, lines.values()))
    for k, rows in lines.items():
        for t, _ in rows:
            held = [y * by for u, y in rows if t - seconds <= u < t and y is not None]
            assert got[(k, t)] == (pytest.approx(sum(held) / len(held), rel=1e-9, abs=1e-15 * by) if len(held) >= 3 else None)


def test_yardstick_of_short_blocks(frame, lines):
    """Blocks of seven rows or so, against a loop over the whole key."""
    rows = frame.where("x is not null")
    got = {(r.k, r.hour): r.sigma for r in blocks.dealt(rows, ["k"], "hour", 7, 2, lambda b, keys: jumps.sigma(b, keys, "x", 7, 2), span=2).collect()}
    for k, line in lines.items():
        line = [x for x in line if x[1] is not None]
        for (t, _), w in zip(line, brute_sigma([t for t, _ in line], [x for _, x in line], 7, 2), strict=True):
            assert got.pop((k, t)) == (None if w is None else pytest.approx(w, rel=1e-9))
    assert not got


@pytest.mark.parametrize(("block", "shape"), [(7, "noise"), (50, "noise"), (10_000, "noise"), (7, "rising"), (7, "falling"), (50, "ties")])
def test_last_row_as_large(spark, frame, lines, block, shape):
    """Rising heights leave every lookup to other blocks; falling ones end at the row before."""
    of = {"noise": lambda t, x: x, "rising": lambda t, x: float(t), "falling": lambda t, x: -float(t), "ties": lambda t, x: float(t % 3)}[shape]
    lows = {k: [(t, None if x is None else of(t, x)) for t, x in rows] for k, rows in lines.items()}
    df = spark.createDataFrame([(k, t, x, "n") for k, rows in lows.items() for t, x in rows], SCHEMA)
    least = F.when(F.col("hour") % 5 != 0, F.col("x") - 0.1)
    out = blocks.last_at_least(df, ["k"], "hour", F.col("x"), least, block)
    assert out.columns == [*df.columns, "since", "since_value"]
    got = {(r.k, r.hour): (r.since, r.since_value) for r in out.collect()}
    assert len(got) == sum(map(len, lows.values()))
    for k, rows in lows.items():
        for i, (t, x) in enumerate(rows):
            hits = [] if x is None or t % 5 == 0 else [(u, y) for u, y in rows[:i] if y is not None and y >= x - 0.1]
            assert got[(k, t)] == max(hits, default=(None, None))


def test_score_and_rarest_in_blocks(frame):
    """The whole detector gives the same rows by blocks as over whole keys."""
    rows = frame.where("x is not null").withColumns({"open": F.exp("x"), "close": F.exp(F.col("x") / 2)})
    detect = lambda b, keys: jumps.score(jumps.channels(b, keys, F.floor(F.col("hour") / 24), hour=1), keys, 80, 4)
    outs = []
    for scored, block in ((blocks.dealt(rows, ["k"], "hour", 80, 2, detect, span=2), 7), (detect(rows, ["k"]), 100_000)):
        rare = jumps.rarest_since(scored, ["k"], 0.5, block=block).select("k", "hour", "since_hour", F.round("since_z", 9).alias("since_z"))
        told = scored.select("k", "hour", "is_open", F.round("r", 9), F.round("gap", 9), F.round("z", 9), "word", "young")
        key = lambda r: (r.k or "", r.hour)
        outs.append([[tuple(r) for r in sorted(x.collect(), key=key)] for x in (told, rare)])
    assert outs[0] == outs[1] and len(outs[0][1]) > 20


def test_tasks_are_blocks(spark):
    """One instrument of many minutes is dealt out by blocks to all tasks."""
    bars = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * 60).alias("hour"), F.exp(F.sin(F.col("id"))).alias("open"))
    bars = bars.withColumn("close", F.col("open") * 1.01)
    yard = lambda b, keys: jumps.sigma(jumps.channels(b, keys, F.lit(0), hour=60), keys, "r", 3600, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = blocks.dealt(bars, ["k"], "hour", 3600, 2, yard, unit=86_400)
        shares = out.where("sigma is not null").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in shares) == 200_000 - 7  # a bar without a move, one without a product, five products
    assert len(shares) == 4 and max(r["count"] for r in shares) < 90_000


@pytest.mark.parametrize("block", [7, 10_000])
def test_smoothing_is_a_scan_of_maps(frame, lines, block):
    """Against the plain recurrence over the whole key, null values in between and at the start."""
    two = frame.withColumn("w", F.when(F.col("hour") > 40, F.col("x") * 10))
    out = blocks.ewm(two, ["k"], "hour", ["x", "w"], 0.3, block)
    assert out.columns == [*two.columns, "x_ewm", "w_ewm"]
    got = {(r.k, r.hour): (r.x_ewm, r.w_ewm) for r in out.collect()}
    for k, rows in lines.items():
        y = w = None
        for t, x in rows:
            if x is not None:
                y = x if y is None else 0.3 * x + 0.7 * y
                if t > 40:
                    w = 10 * x if w is None else 3 * x + 0.7 * w
            assert got[(k, t)] == tuple(None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for v in (y, w))
