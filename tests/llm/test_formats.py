"""Mixing, archives, tokens, licenses and toxicity: round trips, brute force, held-out rows, defined cases."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import common, licenses, mixing, sentencepiece, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, size long, target double, rid long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 0.0, 1) for i, t, s in rows], SCHEMA)


def test_mixing_targets_and_counts(spark):
    rng = np.random.default_rng(5)
    rows = [(
        i, "w " * int(rng.pareto(1.5) * 20), f"s{i % 5}" if i % 7 else None,
    ) for i in range(3000)] + [(None, None, "s1"), (1, "w", "s1"), (1, "w", "s1")]
    got = mixing.mix_sizes(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    assert abs(by["target"].sum() - 1.5 * got["size"].sum()) < 1e-3 and (by["target"] <= 2 * by.index + 1e-6).all()
    assert (abs(by["taken"] - by["target"]) <= 2 * by["top"]).all()
    again = mixing.mix_sizes(frame(spark, rows)).toPandas()
    cols = list(got.columns)
    assert got.sort_values(cols).reset_index(drop=True).equals(again.sort_values(cols).reset_index(drop=True))
    assert mixing.mix_sizes(frame(spark, [])).count() == 0


def test_mixing_documents(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 2}") for i in range(200)]
    out = mixing.mix_documents(frame(spark, rows))
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    taken = sum(len((r.text or "").split()) for r in out.collect())
    assert taken == mixing.mix_sizes(frame(spark, rows)).toPandas()["taken"].sum()


def test_warc_round_trip(spark):
    rows = [
        (1, "http://a/", "<p>x</p>", "k"), (2, None, "<p>x</p>", "k"), (3, "u\r\nX: y", None, "k"), (4, "", "", "k"),
        (None, "http://n/", "é" * 10, "k"), (5, "http://a/", "<p>x</p>", "k"), (6, "b", "z" * 300_000, "k"),
        (7, "WARC/1.1", "\r\n\r\nWARC/1.1\r\n", "k"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.sha1_base32(data)
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds[1] == kinds[2] == ("revisit", 5) and kinds[5] == ("response", None) and kinds[3] == ("revisit", 4) and kinds[4] == ("response", None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_of_repeated_pages(spark):
    rows = [(1, f"http://{i}/", "same", "k") for i in range(40)] + [
        (1, "u", "other", "k"), (0, "u", "same", "k"), (None, "u", "none", "k"), (None, "v", "none", "k"), (2, "u", "alone", "k"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(6)
    got = warc.round_trip(pages).toPandas()
    assert len(got) == len(rows)
    by = {d: g for d, g in got.groupby("payload_digest")}
    same, none = by[warc.sha1_base32(b"same")], by[warc.sha1_base32(b"none")]
    assert (same["record_type"] == "response").sum() == 1 and same["record_type"].count() == 41 and same[same["record_type"] == "revisit"]["refers_to"].eq(1).all()
    assert same[same["record_type"] == "response"]["page_id"].tolist() == [1]
    assert sorted(none["record_type"]) == ["response", "revisit"] and none["refers_to"].isna().all()


def test_warc_of_other_writers(spark, tmp_path):
    def made(kind, block, *lines):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0a1b>", *lines, f"Content-Length: {len(block)}", "", ""]
        return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\nbody"
    raw = made("warcinfo", b"software: x\r\n") + made("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request") + made(
        "response", http, "Content-Type: application/http;msgtype=response", "WARC-Target-URI: http://a/",
    )
    raw += made("metadata", b"", "WARC-Payload-Digest: md5:00") + made("resource", b"text", f"WARC-Payload-Digest: sha1:{warc.sha1_base32(b'text')}")
    (tmp_path / "x.warc.gz").write_bytes(raw)
    got = warc.read_archives(spark, str(tmp_path), "*.warc.gz").collect()
    assert [(r.record_type, r.page_id, r.record_id) for r in got] == [(k, None, "<urn:uuid:0a1b>") for k in (
        "warcinfo", "request", "response", "metadata", "resource",
    )]
    assert [bytes(r.payload) for r in got] == [b"software: x\r\n", b"", b"body", b"", b"text"] and got[2].url == "http://a/"
    assert [r.payload_digest for r in got[2:]] == [warc.sha1_base32(x) for x in (b"body", b"", b"text")]


def test_warc_reader_is_strict():
    rec = warc.record(1, "u", b"payload", warc.sha1_base32(b"payload"))
    both = rec + warc.record(2, "u", b"", warc.sha1_base32(b""))
    assert [r["payload"] for r in warc.read_records(both[i : i + 3] for i in range(0, len(both), 3))] == [b"payload", b""]
    with pytest.raises(ValueError):
        list(warc.read_records([rec[:-9]]))
    plain = gzip.decompress(rec)
    for bad in (plain.replace(b"payload\r", b"pAyload\r"), plain.replace(b"Content-Length: 7", b"Content-Length: 8"), plain[:-1], b"junk" + plain):
        with pytest.raises(ValueError):
            list(warc.read_records([gzip.compress(bad)]))


TEXTS = [
    "", None, "a", " ", "  two  spaces ", "line\nline\n\n", "naïve café – 漢字かな 😀", "x" * 500, "tab\tnull\x00end", "The quick brown fox, 1234567890!",
]


def test_sentencepiece_round_trip(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in sentencepiece.encode_documents(frame(spark, rows)).collect()}
    assert all(r.round_trip for r in out.values()) and out[0].ids == [] and out[1].n_tokens == 0
    assert sentencepiece.encode_documents(frame(spark, [])).count() == 0


def exact_model():
    """The model with scores rounded to 1 / 64, which the public library adds without error, and the library on the same scores."""
    import sentencepiece as lib
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(sentencepiece.MODEL_PATH, "rb") as f:
        raw = f.read()
    m, proto, unit = sentencepiece.Model(raw), pb.ModelProto(), 1 << 26
    m.score = np.rint(m.score / unit).astype(np.int64) * unit
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    normal = [i for i, p in enumerate(proto.pieces) if p.type == 1]
    m.unknown = int(m.score[normal].min()) - (10 << 32)
    for i in normal:
        proto.pieces[i].score = float(m.score[i]) / (1 << 32)
    return m, lib.SentencePieceProcessor(model_proto=proto.SerializeToString()), {proto.pieces[i].piece: int(m.score[i]) for i in normal}


def test_sentencepiece_is_the_best_path(monkeypatch):
    """Id by id against the public library, and scores against the plain dynamic programme over all pieces."""
    m, other, table = exact_model()
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("theranoiéü漢 "), 12)) for _ in range(300)] + ["".join(rng.choice(
        list("theranoiéü漢字"), 3000,
    )) for _ in range(4)] + ["a" * 5000, " " * 300 + "x", *(t for t in TEXTS if t)]
    data, off = common.utf8(pa.array(texts))
    ids, at = m.encode(data, off)
    assert m.decode(ids, at)[0].tobytes() == data.tobytes()
    for n, t in enumerate(texts):
        mine = ids[at[n] : at[n + 1]].tolist()
        assert mine == other.encode(t)
        if len(t) > 600:
            continue
        s = "▁" + t.replace(" ", "▁")
        best = [0] + [-(1 << 62)] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 48) + 1):
                if s[i:j] in table:
                    best[j] = max(best[j], best[i] + table[s[i:j]])
            if s[i] not in table:
                best[i + 1] = max(best[i + 1], best[i] + m.unknown)
        assert sum(int(m.score[i]) for i in mine) + m.unknown * sum(1 for x in s if x not in table) == best[-1]
    # equal hashes of unlike segments do no harm, nor does a cache that is full
    monkeypatch.setattr(common, "span_hashes", lambda d, s, e: (e - s).astype(np.uint64) % np.uint64(5))
    monkeypatch.setattr(sentencepiece, "CACHE_SEGMENTS", 3)
    m._forget()
    again, again_at = m.encode(data, off)
    assert np.array_equal(again, ids) and np.array_equal(again_at, at)


def test_very_long_texts(spark):
    line = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, line, "s"), (2, "漢字かな" * 20_000, "s"), (3, "x" * 100_000, "s"), (4, line[:400_000] + " mit license " + line[:9], "s")]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in sentencepiece.encode_documents(docs).select("doc_id", "n_tokens", "round_trip").collect()}
    assert all(r.round_trip and r.n_tokens > 1000 for r in out.values())
    assert {r.doc_id: r.n_tokens for r in token_files.document_counts(docs, block=1000).collect()} == {i: r.n_tokens for i, r in out.items()}
    assert {r.doc_id: r.base_labels for r in licenses.scan(docs).collect()} == {1: "", 2: "", 3: "", 4: "mit"}


def test_token_counts(spark, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "s"), (3, "again", "s"), (-5, "below zero", "s")]
    docs = frame(spark, rows)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)
    want = sorted((r for r in sentencepiece.encode_documents(docs).select("doc_id", "n_tokens").collect()), key=key)
    for block, size in ((3, 100), (64, 4096), (token_files.BLOCK_TOKENS, token_files.FILE_BYTES)):
        # the plan is dealt out anew at each scan; names and tokens are of one scan
        got = token_files.document_counts(docs.repartition(3, F.rand()), block=block, file_bytes=size).collect()
        assert sorted(got, key=key) == want
    assert token_files.document_counts(frame(spark, [])).count() == 0


def test_token_scan_of_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    ids = rng.choice([2, 7, 9], 500, p=[0.1, 0.5, 0.4]).astype("<u2")
    ids[-1] = 2
    (tmp_path / "part-a").write_bytes(ids.tobytes())
    ends = np.flatnonzero(ids == 2)
    want = np.diff(np.concatenate(([-1], ends))) - 1
    for block in (1, 4, 33, 1000):
        got = token_files.count_tokens(spark, str(tmp_path), block).orderBy("ordinal").collect()
        assert [r.n_tokens for r in got] == want.tolist() and [r.ordinal for r in got] == list(range(len(want)))
    (tmp_path / "part-a").write_bytes(ids[:-1].tobytes() + b"\x07\x00")
    with pytest.raises(Exception, match="lacks its separator"):
        token_files.count_tokens(spark, str(tmp_path), 8).collect()


def license_words(t):
    import re

    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


def brute_spans(t):
    """(template, label, first, last, share) of base phrases and of templates matched in part, by plain loops."""
    w, out = license_words(t), []
    for phrase, label in licenses.PHRASES:
        k = phrase.split()
        out += [(phrase, label, p, p + len(k) - 1, 1.0) for p in range(len(w)) if w[p : p + len(k)] == k]
    for text, label in licenses.TEMPLATES:
        k = text.split()
        found = {(p - i, i) for p in range(len(w) - 1) for i in range(len(k) - 1) if w[p : p + 2] == k[i : i + 2]}
        runs = []
        for d in sorted({d for d, _ in found}):
            if not runs or d - runs[-1][-1] > licenses.NEAR:
                runs.append([])
            runs[-1].append(d)
        for run in runs:
            here = [(d, i) for d, i in found if d in run]
            share = len({i for _, i in here}) / (len(k) - 1)
            if share >= licenses.MIN_SHARE:
                out.append((text, label, min(d + i for d, i in here), max(d + i for d, i in here) + 1, share))
    return w, out


def test_licenses(spark):
    mit, bsd = licenses.WHOLE_TEXTS[0][0], licenses.WHOLE_TEXTS[1][0]
    texts = [None, "", "MIT License", "the Apache-License, and the apache  license; mit license", "cc\nby cc by", "gnu general public licenses", "GNU General public license mit", "miK license", "é mit license é",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files", "gnu lesser general public license", "mit " * 50,
             mit, "see " * 9 + bsd.replace(
                 "the ", "the very ",
             ) + " end", mit[300:] + " mit license", bsd[:500] + " " + mit[400:], "of the " * 300, mit + " " + mit, "gnu affero general public license " * 3]
    docs = frame(spark, [*((i, t, "s") for i, t in enumerate(texts)), (2, "mit license twice: mit license", "s")])
    got = sorted(licenses.scan(docs).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert len(got) == len(texts) + 1
    told = {}
    for r in licenses.spans(docs).collect():
        told.setdefault((r.doc_id, r.rid), []).append((r.template, r.label, r.first_word, r.last_word, r.share))
    all_texts = sorted([*enumerate(texts), (2, "mit license twice: mit license")], key=lambda x: (x[0], len(license_words(x[1]))))
    wanted = []
    for r, (i, t) in zip(got, all_texts, strict=True):
        w, spans = brute_spans(t)
        phrases = [s for s in spans if s[0] in dict(licenses.PHRASES)]
        own = [s for s in spans if s not in phrases]
        starts = [s[2] for s in phrases]
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(w), len(phrases))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({s[1] for s in phrases})) and r.labels == ",".join(sorted({s[1] for s in spans}))
        assert abs(r.score - max([0.0, *(s[4] for s in spans)])) < 1e-12, (i, own)
        if spans:
            wanted.append(sorted(spans))
    assert sorted(sorted(x) for x in told.values()) == sorted(wanted)
    assert got[9 + 1].labels == "mit" and "lgpl" in got[10 + 1].labels
    assert licenses.scan(frame(spark, [])).count() == 0 and licenses.spans(frame(spark, [])).count() == 0


def plain_evidence(lexicon, text):
    """Sum of the weights of terms outside exception phrases, by plain search."""
    t, total = toxicity.fold(text), 0.0
    places = lambda x: [i for i in range(len(t)) if t.startswith(x, i)]
    spared = {j for e in lexicon.exceptions for i in places(e) for j in range(i, i + len(e) - 1)}  # the closing space begins the next word
    for term, weight in lexicon.terms:
        total += sum(weight for i in places(term) if i not in spared)
    return total, len(t.split())


def test_toxicity_scores_by_plain_search(spark):
    lexicon = toxicity.Lexicon(
        ((" vill", 2.0), (" scoundrel ", 3.5), (" rogu", 1.25), (" vile ", 0.5)), (" cartoon scoundrel ", " rogue wave "), (-3.0, 1.0, 0.5),
    )
    long_ = " ".join(["plain words stand here"] * 30_000) + " villain"
    texts = [
        None, "", " ", "a v1lla1n", "VILLAINS and rogues", "the cartoon scoundrel", "cartoon scoundrel scoundrel", "rogue wave rogue", "vile vilе",
        "scoundrel", "x" * 100_000, long_, "villain " * 2000, "ｖｉｌｌａｉｎ", "vil\u00adlain", "no harm",
    ]
    rows = [*((i, t, "s") for i, t in enumerate(texts)), (4, texts[4], "s"), (4, "something else", "s"), (None, texts[3], "s")]
    got = toxicity.score_documents(frame(spark, rows), lexicon).collect()
    made = []
    for i, t, _ in rows:
        total, words = plain_evidence(lexicon, t)
        z = lexicon.model[0] + lexicon.model[1] * np.log1p(total) + lexicon.model[2] * np.log1p(100 * total / (words + 20))
        score = 1 / (1 + np.exp(-z))
        made.append((-9 if i is None else i, round(float(score), 9), int(score >= 0.5), words))
    assert sorted((-9 if r.doc_id is None else r.doc_id, round(r.score, 9), r.predicted, r.n_words) for r in got) == sorted(made)
    assert toxicity.score_documents(frame(spark, []), lexicon).count() == 0
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(frame(spark, []), labels).terms == ()


def test_toxicity_folds_and_learns(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"word{rng.integers(5000)}"
    rows, labels = [], []
    for i in range(600):
        w, bad = [word() for _ in range(30)], i % 3 == 0
        if bad:
            w[3], w[9] = "villain", "scoundrel"
        elif i % 50 == 1:
            w[3:5] = ["cartoon", "scoundrel"]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(docs, known)
    extra = frame(
        spark,
        [
            (1000, "you are a v1lla!n and a sсoundrеl".replace("!", "i"), "s"), (1001, None, "s"), (1002, "", "s"), (None, "villain villain", "s"),
            (1003, "the cartoon scoundrel laughs", "s"),
        ],
    )
    out = {r.doc_id: r for r in toxicity.score_documents(docs.unionByName(extra), lex).collect()}
    assert all(out[i].predicted == y for i, _, y in labels) and any(r.held_out for r in out.values()) and not out[None].held_out
    assert out[1000].predicted == 1 and out[None].predicted == 1 and out[1003].predicted == 0
    assert out[1001].score == out[1002].score < 0.5
    empty = toxicity.fit(docs, known.limit(0))
    assert {r.score for r in toxicity.score_documents(docs.limit(3), empty).collect()} == {0.0}


def test_token_files_end_by_bytes(spark, tmp_path):
    """Files of a few KB, and documents longer than that: each such document ends its file, and no file has another whole one behind it."""
    rows = [(i, ("tokens of a document " * (2000 if i % 7 == 3 else i)).strip(), "s") for i in range(40)]
    token_files.write_files(frame(spark, rows).coalesce(2), str(tmp_path / "t"), file_bytes=4096)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "t").glob("kind=tokens/roll=*/part-*"))
    longest = max(token_files.document_counts(frame(spark, rows)).toPandas()["n_tokens"]) * 2 + 2
    assert len(sizes) > 8 and longest > 4096 and max(sizes) <= 4096 + longest
    got = {r.doc_id: r.n_tokens for r in token_files.document_counts(frame(spark, rows), file_bytes=4096).collect()}
    assert got == {r.doc_id: r.n_tokens for r in sentencepiece.encode_documents(frame(spark, rows)).collect()}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.93
