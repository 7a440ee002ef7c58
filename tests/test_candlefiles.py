"""The archive of candles: round trips, bounded reading, streams that go on, and what is wrong with a file."""

import io
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.sources import candlefiles as cf
from tidewarden.streaming.events import run_to_table

MARCH, APRIL = cf.month_start("2024-03"), cf.month_start("2024-04")


def candles(spark, rows):
    return spark.createDataFrame([(s, side, t, p, p + 1, p - 1, p + 0.5, v) for s, side, t, p, v in rows], cf.SCHEMA)


def rows_of(df):
    return sorted((r.symbol, r.side, r.t, round(r.open, 6), r.volume) for r in df.collect())


def test_round_trip_and_one_symbol(spark, tmp_path):
    rows = [(s, side, t + 3600 * n, 10.0 + n, float(n)) for s in ("A", "B") for side in ("BID", "ASK") for t in (MARCH, APRIL) for n in range(5)]
    path = f"file://{tmp_path}/archive"
    cf.write_candles(candles(spark, rows), path)
    assert sorted(str(f.relative_to(tmp_path / "archive")) for f in (tmp_path / "archive").rglob("*") if f.is_file()) == sorted(
        f"{s}/2024-0{m}/{side}.bi5" for s in "AB" for m in (3, 4) for side in ("ASK", "BID")
    )
    read = spark.read.format("candle_files")
    assert rows_of(read.load(path)) == sorted(rows)
    assert rows_of(read.option("symbol", "B").load(path)) == sorted(r for r in rows if r[0] == "B")
    assert read.option("symbol", "B").load(f"file://{tmp_path}/none").count() == 0
    mids = cf.mids(spark.read.format("candle_files").load(path))
    assert mids.count() == 2 * 2 * 4 and {r.volume for r in mids.collect()} == {1.0, 2.0, 3.0, 4.0}  # the fillers, of no volume, are none


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    cf.write_candles(candles(spark, [("A", "BID", MARCH, 5.0, 1.0)]), path)

    def run():
        stream = spark.readStream.format("candle_files").load(path)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return rows_of(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))

    assert len(run()) == 1 and len(run()) == 1
    cf.write_candles(candles(spark, [("A", "BID", APRIL, 6.0, 1.0), ("A", "ASK", APRIL, 6.0, 1.0)]), path)
    assert run() == [("A", "ASK", APRIL, 6.0, 1.0), ("A", "BID", MARCH, 5.0, 1.0), ("A", "BID", APRIL, 6.0, 1.0)]
    assert run_to_table(spark.readStream.format("candle_files").load(path), "append").count() == 3


def test_pieces_and_broken_files():
    rows = np.zeros(50_000, cf.RECORD)
    rows["seconds"] = np.arange(50_000)
    packed = lzma.compress(rows.tobytes(), format=lzma.FORMAT_ALONE)
    assert max(map(len, cf.pieces(io.BytesIO(packed), 1000))) <= 1000
    got = list(cf.decoded(io.BytesIO(packed), "x/A/2024-03/BID.bi5", 0.01))
    assert len(got) > 2 and sum(b.num_rows for b in got) == 50_000 and got[-1].column(2)[-1].as_py() == MARCH + 49_999
    assert not list(cf.decoded(io.BytesIO(b""), "x/A/2024-03/BID.bi5", 0.01))
    with pytest.raises(ValueError, match="whole number of records"):
        list(cf.decoded(io.BytesIO(lzma.compress(b"x" * 30, format=lzma.FORMAT_ALONE)), "x/A/2024-03/BID.bi5", 0.01))


def test_a_file_in_two_tasks_is_refused(spark, tmp_path):
    cf.register(spark)
    rows = candles(spark, [("A", "BID", MARCH + n, 5.0, 1.0) for n in range(20)]).repartition(3, F.col("t"))
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("candle_files").mode("append").save(f"file://{tmp_path}/archive")
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]
