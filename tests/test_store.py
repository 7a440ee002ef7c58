"""The store by months and settled years."""

from pathlib import Path

from tidewarden.operators.store import read_shards, write_shards
from tidewarden.sources.candlefiles import month_start

SCHEMA = "t long, x int"


def test_shards_are_folded_and_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    frame = lambda months, x=0: spark.createDataFrame([(month_start(m) + 5, x) for m in months], SCHEMA)
    names = lambda: sorted(f.name.removeprefix("shard=") for f in Path(f"{tmp_path}/store").glob("shard=*"))
    rows = lambda: sorted((r.shard, r.t, r.x) for r in read_shards(spark, path, frame([]).schema).collect())
    first = ["2022-11", "2022-12", "2023-01", "2023-03"]
    assert write_shards(frame(first), path) == ["2022", "2023-01", "2023-03"] and names() == ["2022", "2023-01", "2023-03"]
    assert write_shards(frame(first), path) == []  # nothing changed, nothing written
    assert write_shards(frame([*first[:3], "2023-04"]), path) == ["2023-03", "2023-04"] and names() == ["2022", "2023-01", "2023-04"]
    later = [*first, "2023-12", "2024-02"]
    assert write_shards(frame(later), path) == ["2023", "2023-01", "2023-04", "2024-02"] and names() == ["2022", "2023", "2024-02"]
    assert rows() == sorted((s, month_start(m) + 5, 0) for m, s in zip(later, ["2022", "2022", "2023", "2023", "2023", "2024-02"], strict=True))
    # a run that ended before it deleted: the year hides its months, and the next run cleans up
    frame(["2023-05"], 9).write.parquet(f"{path}/shard=2023-05")
    assert all(x == 0 for _, _, x in rows())
    write_shards(frame(later), path)
    assert names() == ["2022", "2023", "2024-02"]
    write_shards(frame([]), path)
    assert names() == [] and rows() == []
