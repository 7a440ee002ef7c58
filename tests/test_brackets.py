"""Balanced blocks against a scanner that goes byte by byte."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidewarden.functions.brackets import balanced, balanced_spans


def scanned(text, marker):
    """The blocks of one text: from the first { after each marker; a quote after an odd run of backslashes is none."""
    out, at = [], text.find(marker)
    while at >= 0:
        i = text.find("{", at + len(marker))
        if i >= 0:
            depth, inside, j = 0, False, i
            while j < len(text):
                c = text[j]
                if c == '"':
                    run = j - len(text[:j].rstrip("\\"))
                    inside ^= run % 2 == 0
                elif not inside:
                    depth += (c == "{") - (c == "}")
                    if depth == 0:
                        out.append(text[i : j + 1])
                        break
                j += 1
        at = text.find(marker, at + 1)
    return out


def made(rng, n):
    return "".join(rng.choice('{}{}"aM=\\') for _ in range(n))


def test_against_a_scanner():
    rng = random.Random(3)
    texts = ["", "M", "M={", 'M={"}"}', 'M={"a\\"}"}x}', "{M{}}", 'q"M={}"', "M={}M={{}}"] + [made(rng, rng.randrange(60)) for _ in range(400)]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = [[] for _ in texts]
    whole = "".join(texts)
    for row, a, b in zip(*balanced_spans(np.frombuffer(whole.encode(), np.uint8), off, b"M", b"{}"), strict=True):
        got[row].append(whole[a:b])
    assert got == [scanned(t, "M") for t in texts] and sum(map(len, got)) > 100


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_column_of_texts(spark, monkeypatch, size):
    from tidewarden.functions import brackets

    monkeypatch.setattr(brackets, "PASS_BYTES", size)
    rows = [(1, 'é D={"k": "}é"} D={1}'), (2, None), (3, "none"), (4, "D={" * 3)]
    got = {r.i: r.blocks for r in balanced(spark.createDataFrame(rows, "i int, t string"), "t", "D=").collect()}
    assert got == {1: ['{"k": "}é"}', "{1}"], 2: None, 3: [], 4: []}


def test_memory_of_a_pass():
    """Numbers are kept of brackets and quotes, not of every byte."""
    text = b'M={"' + b'<p class=\\"x\\">some words of a page</p>' * 50_000 + b'"}'
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tracemalloc.start()
    try:
        spans = balanced_spans(data, off, b"M", b"{}")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x.tolist() for x in spans] == [[0], [2], [len(text)]] and peak < 10 * len(text)


def test_long_texts_come_in_small_batches(spark):
    """A worker gets rows by bytes, not by number, and hands them on in pieces."""
    from tidewarden.functions import brackets

    df = spark.range(0, 400, 1, 1).selectExpr("id", "concat(repeat('x', 60000), 'D={', id, '}') as t")
    one = balanced(df, "t", {"a": "D=", "b": "xD"})
    assert all(r.a == r.b == [f"{{{r.id}}}"] for r in one.where("id % 200 = 7").select("id", "a", "b").collect())
    sizes = df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) < 4 << 20
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["D={1}" + "x" * 1000, None, ""] * 1000).slice(1)})
    parts = list(brackets.with_blocks(iter([batch]), 0, {"blocks": b"D="}, b"{}", brackets.PASS_BYTES))
    assert max(p.column(0).nbytes for p in parts) < 2 * brackets.PASS_BYTES
    assert pa.Table.from_batches(parts)["blocks"].to_pylist() == ([["{1}"], None, []] * 1000)[1:]


def test_page_longer_than_a_json_string_by_default(spark, tmp_path):
    from tidewarden import registry

    page = "concat('<style>p{margin:0}</style>', repeat('x', 20000000)) as html"
    spark.range(1).selectExpr("id as page_id", "'http://a' as url", page).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in registry.QUERIES["G_balanced_blocks"](spark, str(tmp_path)).collect()]
    assert got == [(0, "http://a", 20_000_000 + len("<style>p{margin:0}</style>"), "{margin:0}")]
