"""Every registered query over the smallest tables, against its SQL in DuckDB or a plain loop."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden import registry
from tidewarden.operators import jumps
from tidewarden.queries import detector, texts
from tidewarden.sources import market

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else float(f"{v:.7g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.SQL[name])
    cols = sorted(c[0] for c in got.description)
    place = [[c[0] for c in got.description].index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in place) for r in got.fetchall()]
    assert sorted(df.columns) == cols
    key = lambda r: [(x is None, str(type(x)), str(x)) for x in r]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key) == sorted(want, key=key)


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_basket_problems(spark):
    from tidewarden.operators import basket

    rows = [
        ("a", "x", "b1", "t", 1.0), ("b", "x", "b1", "t", 0.0), ("c", "y", "b1", "t", 1.0), ("d", "x", "b1", "u", 1.0), ("e", "x", "b1", "t", 1.0),
        ("e", "x", "b1", "t", 2.0), ("f", "x", "b2", "t", 1.0), (None, "x", "b1", "t", 1.0),
    ]
    df, told = spark.createDataFrame(
        rows, "ticker string, source string, block string, template string, tick double",
    ), spark.createDataFrame([("t",)], "template string")
    got = sorted((r.ticker or "", r.problem) for r in basket.problems(df, told, ["x"]).collect())
    assert got == [
        ("", "a field is missing"), ("a", ""), ("b", "tick not above zero"), ("c", "unknown source"), ("d", "template not described"),
        ("e", "listed twice"), ("e", "listed twice"), ("f", "block too small"),
    ]
    assert basket.checked(df.where("ticker = 'a' or ticker = 'b'").withColumn("tick", F.lit(1.0)), told, ["x"]).count() == 2
    with pytest.raises(Exception, match="tick not above zero"):
        basket.checked(df, told, ["x"]).collect()
    assert [r.place for r in basket.largest_first(df.where("block = 'b1' and ticker is not null")).orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]


def test_entry_without_corpus_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stretch_against_a_loop(spark):
    m = detector.moves(spark, SF).where("r is not null").select("asset", "hour", "r").orderBy("asset", "hour").collect()
    got = {(r.asset, r.hour): r.in_stretch for r in registry.QUERIES["E3_broken_stretch"](spark, SF).collect()}
    for asset in {r.asset for r in m}:
        rows = [r for r in m if r.asset == asset]
        if not any(abs(r.r) >= 3 for r in rows):
            continue
        inside = [False] * len(rows)
        for k, row in enumerate(rows):
            if inside[k] or abs(row.r) < 3:
                continue
            moved = row.r
            for j in range(k + 1, min(k + jumps.STRETCH_BARS, len(rows))):
                moved += rows[j].r
                inside[j] = True
                if abs(moved) <= jumps.STRETCH_BACK * abs(row.r):
                    break
        assert [got[(asset, r.hour)] for r in rows] == inside


def test_trusted_fixpoint_against_a_loop(spark):
    rows = detector.moves(spark, SF).select("asset", "hour", "r").orderBy("asset", "hour").collect()
    got = {(r.asset, r.hour): r.r for r in registry.QUERIES["E2_trusted_sigma"](spark, SF).collect()}
    from tests.test_windows import brute_sigma

    for asset in {r.asset for r in rows}:
        hours, r = [x.hour for x in rows if x.asset == asset], [x.r for x in rows if x.asset == asset]
        while True:
            s = brute_sigma(hours, r, detector.WEEK, detector.LEAST)
            wrong = [i for i, (a, b) in enumerate(zip(r, s, strict=True)) if a is not None and b and abs(a / b) > 6]
            if not wrong:
                break
            for i in wrong:
                r[i] = None
        for h, x in zip(hours, r, strict=True):
            assert got[(asset, h)] == (None if x is None else pytest.approx(x, abs=1e-6))


def test_trusted_until_a_pass_finds_none(spark):
    """Pairs of outliers, each hidden by the one before until that is gone: one pass for each pair."""
    from tests.test_windows import brute_sigma

    r = [1.0, -1.1] * 5
    for k in range(12):
        r += [1000 * 0.8**k, -1000 * 0.8**k, 1.0, -1.1]
    hours, want, passes = [3600 * i for i in range(len(r))], list(r), 0
    while True:
        passes += 1
        s = brute_sigma(hours, want, 10**7, 5)
        wrong = [i for i, (a, b) in enumerate(zip(want, s, strict=True)) if a is not None and b and abs(a / b) > 6]
        if not wrong:
            break
        for i in wrong:
            want[i] = None
    assert passes > 9
    rows = spark.createDataFrame([("a", h, x) for h, x in zip(hours, r, strict=True)], "asset string, hour long, r double")
    got = {x.hour: x for x in jumps.trusted(rows, ["asset"], 10**7, 5, mistake=6.0, cut=detector.staged).collect()}
    assert [got[h].r for h in hours] == want
    assert [got[h].sigma for h in hours] == [None if x is None else pytest.approx(x, rel=1e-6) for x in s]


def test_streams_keep_all_ticks_over_many_batches(spark, monkeypatch, tmp_path):
    """Ticks without an event_id, most of them of one instrument, in more slices than asked for."""
    from datetime import datetime, timedelta

    from tidewarden.streaming import events

    monkeypatch.setattr(events, "SLICE_ROWS", 30, raising=False)
    ticks = [(
        None if i % 5 == 0 else i, datetime(2024, 3, 1) + timedelta(seconds=i * 4111), i % 7, "buy" if i % 6 else "sell", 50.0 + i * 37 % 41,
        '{"k": 1}',
    ) for i in range(200)]
    spark.createDataFrame(ticks, events.EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    found, acted, start, top = [], [], {}, {}
    for n, at, _, asset, price, _ in ticks:
        t = int((at - datetime(1970, 1, 1)).total_seconds())
        if price <= 60:
            continue
        if asset not in start or t >= start[asset] + 86_400:
            start[asset] = t
        found.append((asset, n, t, start[asset]))
        before = top.get((asset, t // 86_400))
        acted.append((asset, n, "post" if before is None else "edit" if price > before else "silent"))
        top[(asset, t // 86_400)] = max(price, before or price)
    key = lambda r: [(x is None, str(x)) for x in r]
    for name, want in (("H6_event_stream", found), ("H10_action_stream", acted)):
        assert sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
    assert len(list(Path(events.split_files(spark, str(tmp_path), 4).removeprefix("file:")).glob("*.parquet"))) > 4


def test_strings_of_whole_texts(spark, tmp_path):
    text = "word " * 30 + "a < b & c > d End!"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.slug, r.escaped) for r in registry.QUERIES["G_strings_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: ("word_" * 30 + "a_b_c_d_end", "word " * 30 + "a &lt; b &amp; c &gt; d End!"), 2: (None, None)}


def test_pages_keep_blocks_whole():
    state, pages, step = (0, 0), [], texts.page_step(400)
    for size in (100, 300, 200, 500, 10):
        state, (page,) = step(state, size)
        pages.append(page)
    assert pages == [0, 0, 1, 2, 3]


def test_days_of_ticks(spark):
    t = market.ticks(spark, SF)
    assert t.selectExpr("min(t) >= 1704067200").first()[0] and set(t.columns) == {"event_id", "asset", "feed", "t", "price", "size"}


def test_bins_read_by_a_stream(spark, tmp_path):
    """A batch of the sliding yardstick reads its own window's bins, however many batches came before; a late tick reads back to its own."""
    from datetime import datetime, timedelta

    from tidewarden.streaming import events

    rng = np.random.default_rng(9)
    base = datetime(2024, 1, 1)
    rows = [(n, base + timedelta(days=n / 3), 0, "ab"[n % 2], float(10 + rng.random()), '{"k": 1}') for n in range(300)]
    rows.append((300, base + timedelta(days=40), 0, "a", 15.0, '{"k": 1}'))
    for n in range(6):  # 50 ticks a batch, the late one last
        part = rows[n * 50 : n * 50 + 50] + (rows[300:] if n == 5 else [])
        spark.createDataFrame(part, events.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    read = []
    got = events.sliding_stream(events.tick_stream(spark, f"{tmp_path}/t"), 5 * 86_400, 3, lambda n, bins: read.append(bins))
    ticks = spark.createDataFrame(rows, events.EVENTS).selectExpr("event_id", "event_type as asset", "ts", "value as price", "1L as size")
    bars = events.fold(ticks.withColumn("t", market.epoch("ts")), ["asset"], 3600)
    want = jumps.sigma(jumps.channels(bars, ["asset"], F.floor(F.col("hour") / 86_400)), ["asset"], "r", 5 * 86_400, 3)
    rows_of = lambda df: sorted((r.asset, r.hour, None if r.sigma is None else round(r.sigma, 9)) for r in df.collect())
    assert rows_of(got) == rows_of(want.select("asset", "hour", "sigma"))
    assert len(read) == 6 and max(len(b) for b in read[:5]) <= 5 and len(read[5]) > 8


def test_late_ticks_withdraw_bars(spark, tmp_path):
    """A late price of 0 takes back a bar, its yardstick and its place in the opening balances; bars without an instrument stay."""
    from datetime import datetime, timedelta

    from tidewarden.streaming import events

    rng, base, rows = np.random.default_rng(4), datetime(2024, 1, 4), []

    def bar(hour, asset, late=None):
        n = len(rows)
        rows.append((22 * n + 1, base + timedelta(hours=hour), 0, asset, float(10 + rng.random()), '{"k": 1}'))
        if late:
            rows.append((22 * n + 11 * late, base + timedelta(hours=hour, minutes=10), 0, asset, 0.0, '{"k": 1}'))

    for n in range(150):  # 25 days; every ninth bar is taken back, one or two weeks late
        bar(4 * n, "a", 1 + n % 2 if n % 9 == 4 else None)
    bar(2, "b", 1)  # its only bar of the first weeks, taken back
    for n in range(30):
        bar(500 + n, "b")
        bar(500 + n, None)
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted(con.execute(registry.SQL["H5_late_stream"]).fetchall(), key=key)
    got = sorted((tuple(r) for r in registry.QUERIES["H5_late_stream"](spark, str(tmp_path)).collect()), key=key)
    assert got == want and len(got) < 200 and sum(r[2] is not None for r in got) > 100


def test_an_hour_cut_by_batches_withdrawn(spark, tmp_path):
    """An hour whose first ticks one batch brings and whose price of 0 the next: no bar, whichever batch comes first."""
    from datetime import datetime, timedelta

    from tidewarden.streaming import events

    rng, base = np.random.default_rng(5), datetime(2024, 1, 1)
    rows = [(n, base + timedelta(minutes=30 * n), 0, "ab"[n // 2 % 2], float(10 + rng.random()), '{"k": 1}') for n in range(400)]
    rows[201] = (201, rows[201][1], 0, rows[200][3], 0.0, '{"k": 1}')  # the second half of hour 100
    want = duckdb.connect()
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/all")
    want.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/all/*.parquet')")
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted(want.execute(registry.SQL["H5_sliding_stream"]).fetchall(), key=key)
    for name, parts in (("on", (rows[:201], rows[201:])), ("back", (rows[201:], rows[:201]))):
        for part in parts:
            spark.createDataFrame(part, events.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        got = events.sliding_stream(events.tick_stream(spark, f"{tmp_path}/{name}"), 7 * 86_400, 20)
        got = sorted(((r.asset, r.hour, None if r.sigma is None else round(r.sigma, 6)) for r in got.collect()), key=key)
        assert got == want and len(got) == 199


def test_bars_of_ticks_told_out_of_order(spark, tmp_path):
    """First and last of a bar are by event_id, as in the SQL, where times run otherwise; ticks without a time, a price or an event_id."""
    from datetime import datetime, timedelta

    from tidewarden.streaming import events

    rng, base = np.random.default_rng(6), datetime(2024, 1, 1)
    ids = rng.permutation(500).tolist()
    rows = [
        (
            None if n % 50 == 7 else ids[n], None if n % 61 == 9 else base + timedelta(minutes=25 * n), n, "ab"[n // 3 % 2],
            None if n % 40 == 5 else float(10 + rng.random()), '{"k": 1}',
        )
        for n in range(500)
    ]
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    key = lambda r: [(x is None, str(x)) for x in r]
    for name in ("D1_to_hourly", "H1_upsert_stream", "H4_hourly_stream", "H5_sliding_stream"):
        want = sorted(con.execute(registry.SQL[name]).fetchall(), key=key)
        got = sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()), key=key)
        assert got == want and len(got) > 100, name
    assert sum(r[1] is None for r in want) == 2 and sum(r[2] is not None for r in want) > 100  # of H5_sliding_stream


def test_messages_follow_their_hours():
    """A hand-played event: opened, moved, corrected, rung again, struck, back, and never opened by a late hour."""
    from tidewarden.streaming.messages import Event

    e, h = Event(), 3600
    assert e.advance({h: 70.0}, None) == [("post", h, 70.0)]
    assert e.advance({2 * h: 80.0}, 2 * h) == [("edit", 2 * h, 80.0)]  # larger in the same word
    assert e.advance({2 * h: 75.0}, 3 * h) == [("correct", 2 * h, 75.0)]
    assert e.advance({4 * h: 130.0}, 4 * h) == [("post", 4 * h, 130.0)]  # rarer in word
    assert e.advance({2 * h: None}, 5 * h) == [("strike", 2 * h, 75.0)]  # the message before follows its own hour
    assert e.advance({2 * h: 76.0}, 5 * h) == [("correct", 2 * h, 76.0)]
    assert e.advance({4 * h: None}, 6 * h) == [("correct", 2 * h, 76.0)]  # the largest hour left takes its place
    assert e.advance({h: None, 2 * h: None}, 7 * h) == [("strike", 2 * h, 76.0), ("strike", 2 * h, 76.0)]
    assert e.advance({9 * h: 61.0}, 9 * h) == [("post", 9 * h, 61.0)]  # a struck message is not taken up again
    assert e.advance({3 * h: 99.0}, 10 * h) == [("correct", 3 * h, 99.0)]  # a past hour that came late corrects, it doesn't ring
    late = Event()
    assert late.advance({h: 70.0}, 5 * h) == [] and late.advance({h: 71.0}, 6 * h) == []
    assert late.advance({7 * h: 65.0}, 7 * h) == [("post", h, 71.0)]  # a new hour opens the event, at its largest reading
