"""Window tools and bars against brute force and hand values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import bars, calendar, jumps, quality, volatility, vote, windows


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fold_first_last_and_volume(spark):
    t = spark.createDataFrame(
        [("a", 10, 1, 5.0, 1), ("a", 20, 2, 7.0, 2), ("a", 20, 3, 6.0, 3), ("a", 3600, 4, 9.0, 4), ("b", 5, 5, 1.0, 5)],
        "asset string, t long, event_id long, price double, size long",
    )
    assert rows_of(bars.fold(t, ["asset"], 3600), "asset", "hour", "open", "high", "low", "close", "volume", "n_src") == [
        ("a", 0, 5.0, 7.0, 5.0, 6.0, 6.0, 3), ("a", 3600, 9.0, 9.0, 9.0, 9.0, 4.0, 1), ("b", 0, 1.0, 1.0, 1.0, 1.0, 5.0, 1),
    ]
    assert bars.fold(t, ["asset"], 3600, least=2).count() == 1 and bars.fold(t.limit(0), ["asset"], 3600).count() == 0


def test_sigma_by_hand(spark):
    m = spark.createDataFrame([("a", h * 3600, x) for h, x in enumerate((1.0, -2.0, 3.0, -4.0))], "asset string, hour long, r double")
    got = [r[0] for r in jumps.sigma(m, ["asset"], "r", 10**6, 1).orderBy("hour").select("sigma").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(math.sqrt(math.pi / 2 * 2)) and got[3] == pytest.approx(math.sqrt(math.pi / 2 * 4))


def brute_sigma(hours, r, seconds, least):
    valid = [i for i, x in enumerate(r) if x is not None]
    prod = {hours[b]: abs(r[a]) * abs(r[b]) for a, b in zip(valid, valid[1:], strict=False)}
    out = []
    for i, h in enumerate(hours):
        x = [v for t, v in prod.items() if h - seconds <= t < h]
        out.append(math.sqrt(math.pi / 2 * sum(x) / len(x)) if r[i] is not None and len(x) >= least else None)
    return out


def test_sigma_is_brute_force_and_causal(spark):
    rng = np.random.default_rng(1)
    hours = sorted(rng.choice(2000, 400, replace=False).tolist())
    hours = [h * 3600 for h in hours]
    r = [None if rng.random() < 0.1 else float(x) for x in rng.normal(0, 1, 400)]
    schema = "asset string, hour long, r double"
    df = spark.createDataFrame([("a", h, x) for h, x in zip(hours, r, strict=True)], schema)
    full = [x[0] for x in jumps.sigma(df, ["asset"], "r", 200 * 3600, 5).orderBy("hour").select("sigma").collect()]
    for a, b in zip(full, brute_sigma(hours, r, 200 * 3600, 5), strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))
    cut = [x[0] for x in jumps.sigma(df.where(F.col("hour") <= hours[199]), ["asset"], "r", 200 * 3600, 5).orderBy("hour").select("sigma").collect()]
    assert len(cut) == 200 and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(cut, full, strict=False))


def test_one_jump_moves_bipower_little(spark):
    rng = np.random.default_rng(42)
    r = rng.normal(0, 0.001, 300)
    big = r.copy()
    big[150] = 0.02
    of = lambda x: spark.createDataFrame([("a", i * 3600, float(v)) for i, v in enumerate(x)], "asset string, hour long, r double")
    last = lambda df: jumps.sigma(df, ["asset"], "r", 10**7, 5).orderBy(F.desc("hour")).first()["sigma"]
    assert last(of(big)) / last(of(r)) < 1.25 and np.std(big) / np.std(r) > 1.5


def test_trusted_drops_impossible(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 1, 200)
    r[120] = 5000.0
    df = spark.createDataFrame([("a", i * 3600, float(x)) for i, x in enumerate(r)], "asset string, hour long, r double")
    out = {x.hour // 3600: x for x in jumps.trusted(df, ["asset"], 10**6, 10).collect()}
    assert out[120].r is None and out[120].sigma is None and 0.5 < out[199].sigma < 2


def test_event_starts_of_many_keys(spark):
    """Against a plain loop over each key, with and without fixed starts."""
    rng = np.random.default_rng(4)
    found = {k: sorted({int(x) for x in rng.integers(0, 400, rng.integers(0, 30))}) for k in range(60)}
    pins = {k: sorted({int(x) for x in rng.integers(0, 400, rng.integers(0, 4))}) for k in range(60)}
    df = spark.createDataFrame([(k, t) for k, ts in found.items() for t in ts], "k long, found long")
    fixed = spark.createDataFrame([(k, t) for k, ts in pins.items() for t in ts], "k long, anchor long")
    for anchors in (None, fixed):
        got = {(r.k, r.found): r.event_start for r in windows.event_starts(df, "k", "found", 24, anchors).collect()}
        for k, times in found.items():
            last, of = None, pins[k] if anchors is not None else []
            for t in times:
                holding = [p for p in of if 0 <= t - p < 24]
                coming = [p for p in of if 0 < p - t <= 24]
                if holding:
                    want = holding[0]
                elif last is not None and t - last < 24:
                    want = last
                elif coming:
                    want = coming[0]
                else:
                    want = last = t
                assert got.pop((k, t)) == want
        assert not got


@pytest.mark.parametrize("upto", [False, True])
def test_earlier_rows_of_a_size(spark, upto):
    rng = np.random.default_rng(8)
    rows = [(k, t, float(rng.integers(0, 12))) for k in range(3) for t in sorted(rng.permutation(200)[: 5 if k == 2 else 60].tolist())]
    df = spark.createDataFrame(rows, "k int, at long, x double")
    got = {(r.k, r.at): (r["_n"], r["_last"] and r["_last"].at) for r in windows.earlier_at_least(
        df, ["k"], "at", F.col("x"), F.col("x") * 0.9, ["at"], upto=upto,
    ).collect()}
    for k, t, x in rows:
        hits = [u for j, u, y in rows if j == k and (u < t or upto and u == t) and y >= 0.9 * x]
        assert got[(k, t)] == (len(hits), max(hits, default=None))


def test_trailing_rows_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(2)
        rows = [(k, t, None if rng.random() < 0.2 else float(rng.normal())) for k in "ab" for t in range(40)]
        df = spark.createDataFrame(rows, "k string, t long, x double")
        got = {(r.k, r.t): (r.q95, r.q99) for r in volatility.trailing_quantiles(df, ["k"], "t", "x", 15, 5).collect()}
        count = lambda n, x: (n + 1, (n, x))
        folds = {(r.k, r.t): (r.n, r.y) for r in windows.folded(df, ["k"], "t", ["x"], count, lambda: 0, "n bigint, y double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, t, x in rows:
        w = [y for j, u, y in rows if j == k and t - 15 <= u < t and y is not None]
        want = (np.quantile(w, 0.95), np.quantile(w, 0.99)) if len(w) >= 5 else (None, None)
        assert got[(k, t)] == (pytest.approx(want) if want[0] is not None else want)
        assert folds[(k, t)] == (t, x)


def test_asof_in_bins(spark):
    rng = np.random.default_rng(6)
    left = [(str(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(-40, 300, 80), strict=True))]
    right = sorted({(str(k), int(t)) for k, t in zip(rng.integers(0, 3, 12), rng.integers(-40, 300, 12), strict=True)})
    a, b = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame([(k, t, t) for k, t in right], "k string, u long, v long")
    got = {r.i: r.v for r in windows.asof_backward(a, b, ["k"], "t", "u", ["v"], bin_size=25).collect()}
    assert got == {i: max((u for j, u in right if j == k and u <= t), default=None) for k, t, i in left}


def test_range_mean_late_in_a_long_series(spark):
    rows = [("a", t, 1e7 if t < 50 else 1e-9 * (t % 3)) for t in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    got = {r.t: r.m for r in df.withColumn("m", windows.range_mean("x", "t", ["k"], 10, 1)).collect()}
    assert got[150] == pytest.approx(np.mean([1e-9 * (t % 3) for t in range(140, 150)]), rel=1e-9)


def test_futures_calendar_by_counting_days(spark):
    from datetime import date, timedelta

    def back(day, n):
        while n:
            day -= timedelta(days=1)
            n -= day.weekday() < 5
        return day

    days = [date(2023, 12, 20) + timedelta(days=i) for i in range(40)]
    df = spark.createDataFrame([(d, n) for d in days for n in range(13)], "d date, n int")
    for r in df.withColumn("b", calendar.weekdays_before(F.col("d"), F.col("n"))).collect():
        assert r.b == back(r.d, r.n)
    c = {(r.ticker, r.year, r.month): r for r in calendar.contracts(spark, spark.createDataFrame([(2024,), (2025,)], "year int")).collect()}
    assert c[
        "ZC=F", 2024, 12,
    ].last_day == date(2024, 12, 13) and c["BZ=F", 2025, 1].last_day == date(2024, 11, 29) and c["LE=F", 2024, 8].last_day == date(2024, 8, 30)
    assert c["ZC=F", 2024, 9].held is False and c["ZC=F", 2024, 9].contract == "ZCU24.CBT" and ("KC=F", 2024, 1) not in c


def test_event_starts_by_hand(spark):
    df = spark.createDataFrame([("a", h * 3600) for h in (0, 23, 24, 47, 49)], "asset string, found long")
    assert [s // 3600 for _, s in rows_of(windows.event_starts(df, "asset", "found", 86400), "found", "event_start")] == [0, 0, 24, 24, 49]
    pins = spark.createDataFrame([("a", 25 * 3600)], "asset string, anchor long")
    assert [s // 3600 for _, s in rows_of(windows.event_starts(df, "asset", "found", 86400, pins), "found", "event_start")] == [0, 0, 25, 25, 49]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_asof(spark, seed):
    rng = np.random.default_rng(seed)
    left = [(str(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60), strict=True))]
    right = sorted({(str(k), int(t)) for k, t in zip(rng.integers(0, 3, 20), rng.integers(0, 50, 20), strict=True)})
    a = spark.createDataFrame(left, "k string, t long, i long")
    b = spark.createDataFrame([(k, t, t) for k, t in right], "k string, u long, v long")
    back = {r.i: r.v for r in windows.asof_backward(a, b, ["k"], "t", "u", ["v"]).collect()}
    ahead = {r.i: r.v for r in windows.asof_forward(a, b, ["k"], "t", "u", ["v"]).collect()}
    for k, t, i in left:
        assert back[i] == max((u for q, u in right if q == k and u <= t), default=None)
        assert ahead[i] == min((u for q, u in right if q == k and u > t), default=None)


def test_upsert_cases(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 9, 1.0), ("a", 8, 1.0)], "asset string, hour long, close double")
    n = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 9, 5.0), ("a", 3, 5.0), ("a", 10, 5.0)], "asset string, hour long, close double")
    once = bars.upsert(s, n, ["asset", "hour"], F.col("hour") < 5)
    want = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 5.0), ("a", 8, 1.0), ("a", 9, 5.0), ("a", 10, 5.0)]
    assert rows_of(once, "asset", "hour", "close") == want
    assert rows_of(bars.upsert(once, n, ["asset", "hour"], F.col("hour") < 5), "asset", "hour", "close") == want


def test_islands(spark):
    d = spark.createDataFrame([("a", x) for x in (1, 2, 5, 9, 10, 20)], "k string, d long")
    assert rows_of(bars.islands(d, ["k"], "d", 3), "first", "last", "n") == [(1, 5, 3), (9, 10, 2), (20, 20, 1)]


def test_validation_order(spark):
    b = spark.createDataFrame(
        [
            (1.0, 2.0, 0.5, 1.5, 1.0), (None, 2.0, 0.5, 1.5, 1.0), (0.0, 2.0, 0.0, 1.5, -1.0), (3.0, 2.0, 0.5, 1.5, -1.0), (1.0, 2.0, 0.5, 1.5, -1.0),
            (2.005, 2.0, 0.5, 1.5, 1.0),
        ],
        "open double, high double, low double, close double, volume double",
    )
    assert [r[0] for r in b.select(quality.invalid_reason(0.01)).collect()] == [
        "", "removed", "not above zero", "body outside range", "volume below zero", "",
    ]


def test_tally(spark):
    j = spark.createDataFrame(
        [
            ("x", 1, 0, "confirmed"), ("x", 1, 1, "unknown"), ("x", 2, 0, "unconfirmed"), ("x", 3, 0, "unconfirmed"), ("x", 3, 1, "unconfirmed"),
            ("x", 4, 0, "unknown"),
        ],
        "asset string, hour long, feed long, answer string",
    )
    assert rows_of(vote.tally(j), "hour", "verdict", "n_yes", "n_no", "seen") == [
        (1, "real", 2, 0, "0"), (2, "uncertain", 1, 1, ""), (3, "not real", 1, 2, ""), (4, "uncertain", 1, 0, ""),
    ]


def test_mad_and_ewma(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 41 == 7 else float(v) for i, v in enumerate(rng.normal(0, 1, 150))]
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "series string, day long, r double")
    got = {r.day: r.mad for r in volatility.rolling_mad(d, ["series"], "day", "r", 24).collect()}
    for i in range(150):
        w = x[i - 24 : i] if i >= 24 else [None]
        want = None if None in w else float(np.median(np.abs(np.array(w) - np.median(w))))
        assert got[i] == (pytest.approx(want) if want is not None else None)
    lt = {r.day: r.sigma_lt for r in volatility.long_run_sigma(d, ["series"], "day", "r", 60, 0.94, 20).collect()}
    for i in (30, 90, 149):
        sq = [v * v for v in x[max(0, i - 60) : i] if v is not None]
        w = [0.94 ** (len(sq) - 1 - k) for k in range(len(sq))]
        assert lt[i] == pytest.approx(math.sqrt(sum(a * b for a, b in zip(sq, w, strict=True)) / sum(w)))


def test_ewma_steps_against_a_loop(spark):
    rng = np.random.default_rng(9)
    x = [float(v) for v in rng.normal(0, 1, 120)]
    x[70] = 40.0
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "series string, day long, r double")
    got = {r.day: (r.z, r.sd) for r in windows.folded(
        d, ["series"], "day", ["r"], volatility.ewma_step, volatility.ewma_start, "z double, sd double",
    ).collect()}
    mean = var = 0.0
    for i, v in enumerate(x):
        sd = math.sqrt(var)
        z = (v - mean) / sd if i >= 20 else None
        assert got[i][1] == pytest.approx(sd) and (got[i][0] == pytest.approx(z) if z is not None else got[i][0] is None or math.isnan(got[i][0]))
        u = v if z is None else mean + max(-5, min(5, z)) * sd
        mean, var = 0.94 * mean + 0.06 * u, 0.94 * var + 0.06 * (u - mean) ** 2
