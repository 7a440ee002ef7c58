"""The pipeline against a chain of plain loops, and the corpus queries against their SQL."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.llm import test_text_operators as plain
from tidewarden.llm import common, mixing, queries, sentencepiece

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, size long, __row string"


def prose(i, n=70):
    return " ".join(f"word{(i * 7919 + j * j) % 5000}" for j in range(n))


def corpus():
    rows = [(i, prose(i), "s0" if i % 3 else "s1") for i in range(30)]
    rows += [
        (100, prose(1), "s1"), (101, prose(1).replace(" ", "  "), None), (None, prose(2), "s0"), (102, prose(3) + " one two", "s0"),
        (None, prose(4) + " and more", None), (103, prose(40) + " end", "s2"), (None, prose(40), "s2"),
    ]
    rows += [(5, prose(5), "s0"), (5, prose(5), "s0"), (6, prose(90), "s1"), (7, prose(91) + " x", "s1"), (7, prose(6) + " y", "s1")]
    rows += [
        (200, None, "s0"), (None, None, None), (201, "", "s1"), (202, "too short", "s0"), (203, "### " * 80, "s1"), (204, "ok " * 90, "s1"),
        (205, " ".join(prose(i, 600) for i in range(300, 330)), "s2")
    ]
    return rows


def passes(text):
    n_words, chars, symbols, dup, repeat = plain.base_counts(text)
    lines = sum(1 for x in (text or "").split("\n") if plain.words(x))
    letters = sum(1 for x in text or "" if x.isascii() and x.isalpha() or ord(x) > 127)
    bad = n_words < 50, 100 * repeat > 50 * n_words, 100 * symbols > 30 * n_words, chars < 2 * n_words or chars > 20 * n_words, 100 * letters < 50 * chars, 100 * dup > 40 * lines
    return not any(bad)


def first(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def one_of_each(rows, group):
    """One row of each group: that of the smallest doc_id, null last."""
    by = {}
    for r, g in zip(rows, group, strict=True):
        by.setdefault(g, []).append(r)
    return [first(x) for x in by.values()]


def near_groups(rows):
    """A number for each row's component; rows without words are alone."""
    sets = []
    for _, t, _ in rows:
        w = plain.words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def named(rows):
    return sorted((r[0] if r[0] is not None else -1, r[1] or "", r[2] or "") for r in rows)


def test_pipeline_against_a_chain_of_loops(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, s, 0, 9, 8, "x") for i, t, s in rows], SCHEMA)
    wanted = [r for r in rows if passes(r[1])]
    wanted = [wanted]
    wanted.append(one_of_each(wanted[0], [re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t, _ in wanted[0]]))
    wanted.append(one_of_each(wanted[1], near_groups(wanted[1])))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == before.columns, name
        got = docs.collect()
        if n < 3:
            assert named((r.doc_id, r.text, r.source) for r in got) == named(wanted[n]), name
        elif n == 3:
            sizes = mixing.mix_sizes(before).collect()
            assert sum(len(plain.words(r.text)) for r in got) == sum(r.taken for r in sizes)
            assert all(sum(1 for r in got if r.text == t) <= 2 for _, t, _ in wanted[2])
            mixed = got
        else:
            model = sentencepiece.load()
            assert all(r.round_trip for r in got) and len(got) == len(mixed)
            import numpy as np

            texts = sorted(model.decode(np.array(r.ids, np.int32), np.array([0, len(r.ids)]))[0].tobytes().decode() for r in got)
            assert texts == sorted(r.text for r in mixed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else float(f"{v:.7g}")
    return v


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(queries.SQL[name])
    cols = sorted(c[0] for c in got.description)
    place = [[c[0] for c in got.description].index(c) for c in cols]
    want = [tuple(same(r[i]) for i in place) for r in got.fetchall()]
    df = queries.QUERIES[name](spark, SF)
    key = lambda r: [(x is None, str(type(x)), str(x)) for x in r]
    assert sorted(df.columns) == cols
    assert sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=key) == sorted(want, key=key)


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())
