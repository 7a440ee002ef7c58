"""Quality rules, de-duplication, repeats and joins against brute force, and the defined cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import common, exact_dedup, ngram_join, quality, suffix_dedup

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "x", 1, 2) for i, t in rows], SCHEMA)


def odd_rows():
    long_ = " ".join(f"w{i}" for i in range(40_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, BASE), (4, BASE), (5, BASE + "\n"), (6, BASE.upper()), (None, BASE), (None, None), (7, long_),
        (8, long_ + " more"), (9, "a b"), (10, "a b"), (11, "é ü 漢字 x"),
    ]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_counts(t):
    t, w = t or "", words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else {}
    rep = {i + k for i, g in enumerate(grams) if seen.get(g, 1) > 1 for k in range(3)}
    lines, dup, known = t.split("\n"), 0, set()
    for x in lines:
        if words(x):
            dup += x in known
            known.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep)


def test_quality_counts(spark):
    rows = [*odd_rows(), (20, "a b c a b c x\nsame line\nsame line\n \n \n#*$"), (21, "x\n\nx\nx"), (22, "é é é é é é")]
    got = sorted((
        r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
    ) for r in quality.score_documents(frame(spark, rows)).collect())
    assert got == sorted((i or -1, *base_counts(t)) for i, t in rows)


def test_quality_order_does_not_matter():
    texts = [BASE * 4, "### " * 60, "ok " * 80, " ".join(f"word{i}" for i in range(99)), ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    names = [r.name for r in quality.RULES]
    first = quality.cascade(quality.Texts(data, off), tuple(names)).tolist()
    assert first == quality.cascade(quality.Texts(data, off), tuple(reversed(names))).tolist() == [3]


def test_quality_keeps_columns(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(99))), (2, "short"), (3, None)]
    out = quality.filter_documents(frame(spark, rows))
    assert out.columns == [f.split()[0] for f in SCHEMA.split(", ")] and [r.doc_id for r in out.collect()] == [1]
    assert quality.filter_documents(frame(spark, [])).count() == 0 and quality.score_documents(frame(spark, [])).count() == 0


def test_exact_groups(spark):
    rows = odd_rows()
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    for r in got:
        same = [i for i, t in rows if norm(t) == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == min((i for i in same if i is not None), default=None)
    for d in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == d) == 1
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_heavy_hitters_give_the_same(spark):
    rows = [(i, "hot" if i % 3 else f"own {i // 6}") for i in range(600)]
    light = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows), share=1.0).collect()}
    heavy = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows), share=0.01).collect()}
    assert light == heavy and heavy[2] == (1, 400, False)


def test_drop_copies(spark):
    rows = odd_rows()
    out = exact_dedup.drop_copies(frame(spark, rows))
    assert len(out.columns) == 8
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert kept == sorted(r.doc_id if r.doc_id is not None else -1 for r in exact_dedup.exact_groups(frame(spark, rows)).where("kept").collect())
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def brute_components(rows, k=5, t=75):
    sets = []
    for _, x in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= t * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components(spark, seed):
    rng = np.random.default_rng(seed)
    rows, n = odd_rows(), 100
    base = [f"v{rng.integers(60)}" for _ in range(60)]
    for i in range(90):  # near copies of several degrees, with a passage that many share
        w = list(base) if i % 3 else [f"u{rng.integers(40)}" for _ in range(30)] + base[:12]
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = f"x{rng.integers(1000)}"
        rows.append((n + int(rng.permutation(1000)[0]) * 100 + i, " ".join(w)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in ngram_join.near_components(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_components(rows), key=key)


def test_ngram_links_of_null_and_repeated_ids(spark):
    other = " ".join(f"q{i}" for i in range(60))
    rows = [
        (5, BASE * 3), (None, BASE * 3 + " and more"), (7, BASE * 3 + " and more still yet"), (None, other), (9, other + " x"),
        (9, BASE * 3 + " and"), (9, "words that are like nothing else here at all"), (None, None),
    ]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in ngram_join.near_components(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_components(rows), key=key)
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in ngram_join.keep_one(frame(spark, rows[:-1])).collect())
    assert kept == [(5, BASE * 3), (9, other + " x"), (9, "words that are like nothing else here at all")]


def test_ngram_keep_one_of_repeated_rows(spark):
    rows = [(1, BASE), (1, BASE), (1, "\t" + BASE), (2, None), (2, None), (3, ""), (4, "a b"), (4, "a b")]
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert [i for i, _ in kept] == [1, 2, 2, 3, 4] and ngram_join.keep_one(frame(spark, [])).count() == 0


def test_ngram_hot_shingles_and_many_rounds(spark, monkeypatch):
    """Shingles dealt to several tasks, and more rounds than one, give the same links."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 4)
    monkeypatch.setattr(ngram_join, "LEADERS", (1, 2))
    rng = np.random.default_rng(7)
    base = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(len(w))] = f"x{rng.integers(30)}"
        rows.append((int(rng.permutation(500)[0]) * 200 + i, " ".join(w)))
    got = sorted(tuple(r) for r in ngram_join.near_components(frame(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_ngram_empty_and_keep_one(spark):
    assert ngram_join.near_components(frame(spark, [])).count() == 0
    rows = [(1, BASE), (2, BASE + " more"), (3, "other words that have nothing in common with it"), (4, None)]
    out = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4] and len(out.columns) == 8


def brute_repeats(rows, width):
    last = 1 << 62
    out, by = [], sorted({last if i is None else i for i, _ in rows})
    seen, at = {}, {d: n for n, d in enumerate(by)}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            d = at[last if i is None else i]
            seen[w] = min(seen.get(w, d), d)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < at[last if i is None else i]:
                gone[p : p + width] = b"\1" * width
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_repeats(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcé \n"), n))
    shared, rows = text(300), [r for r in odd_rows() if len(r[1] or "") < 2000]
    for i in range(60):
        a, b = sorted(rng.integers(0, 300, 2))
        rows.append((100 + int(rng.integers(50)), text(int(rng.integers(0, 60))) + shared[a:b] + text(int(rng.integers(0, 60)))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_repeats(rows, 50), key=key)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [200, 700, 1 << 20])
def test_repeats_at_several_places_of_a_document(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    passage, other = text(180), text(90)
    rows = [(1, text(20) + passage + text(30)), (2, "x" + text(300)), (3, passage + text(70) + passage + text(9) + passage)]
    rows += [
        (4, other + text(40) + other), (4, text(11) + other + passage[20:100]), (5, text(5) + other + other),
        (None, passage[:120] + text(8) + passage[:120]), (None, "z" + other + other),
    ]
    rows += [(10 + i, text(15).join([passage[i : i + 100], other[i : i + 70], passage[i : i + 100], other])) for i in range(8)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows).repartition(5, "doc_id")).collect()), key=key)
    assert got == sorted(brute_repeats(rows, 50), key=key)


@pytest.mark.parametrize("gb", [1, 10])
def test_repeats_blobs_keep_their_size(spark, monkeypatch, gb):
    """The lists that a shard deals out are no shorter for ten times the text."""
    dealt = []

    def held(docs, buckets, width):
        dealt.append(buckets)
        raise StopIteration

    monkeypatch.setattr(suffix_dedup, "_list_anchors", held)
    long_ = F.repeat(F.lit("a"), 1 << 20)
    docs = spark.range(gb << 10).select(F.col("id").alias("doc"), F.lit(0).alias("key_a"), F.lit(0).alias("key_b"), long_.alias("text"))
    with pytest.raises(StopIteration):
        suffix_dedup.repeated_spans(docs)
    anchors = suffix_dedup.SHARD_BYTES * 2 / (suffix_dedup.WIDTH - suffix_dedup.GRAM + 2)
    assert anchors / dealt[0] >= 2000


def test_repeats_beside_an_anchor(spark, monkeypatch):
    """Documents that have an anchor in common meet only in windows that reach to its left, only to its right, or not at all."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    rng = np.random.default_rng(21)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    common, rows = text(140), []
    for i in range(90):
        a = int(rng.integers(0, 90))
        rows.append((int(rng.integers(0, 70)), text(int(rng.integers(0, 40))) + common[a : a + int(rng.integers(30, 62))] + text(int(rng.integers(0, 40)))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows).repartition(6, "doc_id")).collect()), key=key)
    assert got == sorted(brute_repeats(rows, 50), key=key) and any(r[2] for r in got)


def test_repeats_of_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than a piece, rows of null and repeated ids that are near copies of one another."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefghij \n"), n))
    long_ = text(2500)
    rows = [
        (3, long_), (None, long_[:1200] + "!" + long_[1201:]), (None, text(40) + long_[700:1500]), (8, text(30) + long_[250:420] + text(30)),
        (8, long_[900:1000] + text(99)), (2, text(10) + long_[295:360]),
    ]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()), key=key)
    assert got == sorted(brute_repeats(rows, 50), key=key)
    with pytest.raises(ValueError):
        suffix_dedup.anchors(np.zeros(9, np.uint8), np.array([0, 9]), width=300)


def kasai(text, order):
    """The plain loop: common prefixes in text order, each at least the one before less one."""
    n, h = len(text), 0
    rank = {int(p): i for i, p in enumerate(order)}
    out = [0] * n
    for i in range(n):
        if rank[i]:
            j = int(order[rank[i] - 1])
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 7, 8, 9, 40, 300):
        text = rng.integers(0, letters, n).astype(np.uint8)
        raw = text.tobytes()
        order, _ = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        assert suffix_dedup.common_prefixes(text, order, n + 8).tolist() == kasai(raw, order)


def thue_morse(n):
    """n letters a and b that polynomial hashes modulo 2^64 map to the value of their complement."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def swapped(text):
    return text.translate(str.maketrans("ab", "ba"))


def test_structured_texts_do_not_collide(spark):
    rows = []
    for n in (64, 512, 1024, 2048, 4096):
        x, y = thue_morse(n), swapped(thue_morse(n))
        data = np.frombuffer((x + y + x).encode(), np.uint8)
        at, size = np.array([0, n, 2 * n]), np.full(3, n)
        h = common.span_hashes(data, at, at + n)
        assert h[0] == h[2] != h[1]
        assert common.equal_spans(data, at, data, at[[0, 0, 0]], size, size).tolist() == [True, False, True]
        texts = [
            f"{x}\n{y}\n{x}", x, y, " ".join([x, y, "c"] * 2 + [y, x, "c"]), f"{x} one two three four five six", f"{y} one two three four five six",
        ]
        rows += [(n + i, t) for i, t in enumerate(texts)]
    got = sorted((
        r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
    ) for r in quality.score_documents(frame(spark, rows)).collect())
    assert got == [(i, *base_counts(t)) for i, t in rows]
    assert {r.doc_id: r.component_id for r in ngram_join.near_components(frame(spark, rows)).collect()} == {i: c for i, _, c in brute_components(rows)}


def test_colliding_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash that maps all spans to one value, results stay."""
    texts = ["x y x\nline\nother\nline", "a b c a b c", "a b c d", "line\nline"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    monkeypatch.setattr(common, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    t = quality.Texts(data, off)
    assert [(int(d), int(r)) for d, r in zip(t.lines[1], t.n_repeat_words, strict=True)] == [base_counts(x)[3:] for x in texts]
    assert t.rows(np.array([True, False, True, True])).n_words.tolist() == [6, 4, 2]
    at, size = np.array([0, 2, 6, 11]), np.array([1, 1, 4, 4])
    same = suffix_dedup._same_texts(data, at, size, np.ones(4, np.int64), np.zeros(4, np.int64))
    told = [bytes(data[a : a + n]) for a, n in zip(at, size, strict=True)]
    assert [[a == b for b in same] for a in same.tolist()] == [[a == b for b in told] for a in told]


def test_hashes_of_spans():
    data = np.frombuffer(b"abc abd abc  ab", np.uint8)
    s, e, n = common.word_spans(data, np.array([0, 3, 3, 15]))
    assert n.tolist() == [1, 0, 3] and [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"abc", b"abd", b"abc", b"ab"]
    h = common.span_hashes(data, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
