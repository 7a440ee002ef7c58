"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, licenses, line_dedup, merkle, mixing, ngram_join, quality, sentencepiece, suffix_dedup, token_files, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_counts(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_exact_dedup, op4_ngram_jaccard, op5_mixing, op6_warc, op7_suffix_dedup, op8_sentencepiece, op9_token_counts,
    op10_license_scan, op11_merkle_manifest, op12_whitening, op13_line_dedup,
)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {_WORDS} AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT rid, i, word, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line,
  '[^\x20\x09-\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, sum(n - 1) AS n_dup, sum(n) AS n_lines FROM l GROUP BY rid),
s AS (
  SELECT d.rid, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text,
  '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(text,
  '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 30 * n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
    AND NOT (100 * n_letters < 50 * word_chars) AND NOT (100 * n_dup_lines > 40 * n_lines) AS kept
FROM f
"""

_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM
  documents),
k AS (SELECT rid, doc_id, digest, row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS LAST, rid) AS nth FROM d),
g AS (SELECT digest, count(*) AS n, min(doc_id) AS keep_id FROM k GROUP BY digest)
SELECT doc_id, keep_id, n::BIGINT AS group_size, nth = 1 AS kept, digest AS text_sha256 FROM k JOIN g USING (digest)
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS
  ws FROM documents
), p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT doc_id, n, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM p WINDOW o AS
  (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, d, e) AS g FROM q WHERE i <= n - 4 OR (n < 5 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n_both FROM s l JOIN s r ON l.g = r.g AND l.doc_id <> r.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM x JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * n_both >= 75 * (za.n + zb.n - n_both)),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat('mix-1:',
  coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS
  w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size / w AS bound, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM p),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM p) - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / ((SELECT sum(w) FROM p) -
  coalesce(sum(w) OVER b, 0)) AS level FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, k) AS level FROM v WHERE level <= bound),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT level FROM lv)) AS target, ('0x' || substr(md5(concat('mix-1:offset:',
  coalesce(source, ''))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM o),
c AS (SELECT *, CASE WHEN size < 1 THEN -1 ELSE floor(log2(size + 0.5::DOUBLE)) * 4 + floor(size * 4.0::DOUBLE / pow(2.0::DOUBLE, floor(log2(size +
  0.5::DOUBLE)))) - 4 END AS cls FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, substr(h, 1, 2), size, h, doc_id) AS i FROM c),
j AS (SELECT n.doc_id, n.size, t.source_size, t.target, n.i, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS
  rate FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(i::DOUBLE * rate + u) - floor((i - 1)::DOUBLE * rate + u))::BIGINT * size)::BIGINT AS taken FROM j
"""

_OP6 = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, first_value(page_id) OVER o AS top_id, first_value(rid) OVER o AS top FROM p WINDOW o AS (PARTITION BY h ORDER BY page_id DESC NULLS
  LAST, rid DESC))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT
  >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN rid = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rid <> top THEN top_id END AS refers_to
FROM g
"""

#: A window is 50 bytes, 100 hexadecimal digits, cut from pieces of 1,000 windows; a row number stands for the row.
_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(coalesce(text, '')) AS x FROM documents),
c AS (SELECT rid, doc, x, unnest(range((length(x) // 2 - 50) // 1000 + 1)) AS piece FROM d WHERE length(x) >= 100),
y AS (SELECT rid, doc, piece, substr(x, 2000 * piece + 1, 2098) AS y FROM c),
b AS (SELECT rid, doc, piece, y, unnest(range(length(y) // 2 - 49)) AS i FROM y),
w AS (SELECT rid, doc, 1000 * piece + i AS p, substr(y, 2 * i + 1, 100) AS s FROM b),
m AS (SELECT s, min(doc) AS least FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT rid, p, coalesce(p - lag(p) OVER (PARTITION BY rid ORDER BY p) > 50, true) AS fresh FROM w JOIN m USING (s) WHERE doc > least),
n AS (SELECT rid, p, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY p) AS span FROM g),
r AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY rid, span),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY rid ORDER BY a) IS NULL AS final
  FROM r),
t AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)) || CASE WHEN final THEN substr(x,
  2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""


def _op10() -> str:
    """Phrases are found by the words that follow one another; templates by votes for diagonals."""
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else "NULL" if x is None else str(x)
    table = lambda rows: ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    phrases = [(*p.split(), *[None] * (4 - len(p.split())), label) for p, label in licenses.PHRASES]
    templates = [(n, at, *pair.split(), size, label) for n, at, pair, size, _, label in licenses.template_rows((), licenses.TEMPLATES)]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  AS ws
  FROM documents
), p AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS pos FROM d),
q AS (SELECT rid, pos, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
f(a, b, c, e, label) AS (VALUES {table(phrases)}),
h AS (SELECT rid, pos, label FROM q JOIN f ON q.a = f.a AND q.b = f.b AND (f.c IS NULL OR q.c = f.c) AND (f.e IS NULL OR q.e = f.e)),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM h GROUP BY rid),
t(template, spot, a, b, n, label) AS (VALUES {table(templates)}),
v AS (SELECT DISTINCT rid, template, n, label, spot, pos - spot AS diagonal FROM q JOIN t ON q.a = t.a AND q.b = t.b),
g AS (SELECT rid, template, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {licenses.NEAR}, true)
  AS apart FROM (SELECT DISTINCT rid, template, diagonal FROM v)),
u AS (SELECT rid, template, diagonal, sum(apart::INT) OVER (PARTITION BY rid, template ORDER BY diagonal) AS passage FROM g),
s AS (SELECT rid, label, count(DISTINCT spot)::DOUBLE / n AS share FROM v JOIN u USING (rid, template, diagonal) GROUP BY rid, template, n, label,
  passage),
own AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM s WHERE share >= {licenses.MIN_SHARE} GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(share, 0.0::DOUBLE)) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""

#: Levels and folds by recursion; a row number stands for the row. CRC-32 bit by bit over the decimal's bytes.
_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || lang, '-') AS grp, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS fields,
    [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS forged,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
      list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM documents),
h AS (SELECT rid, doc_id, grp,
    sha256(array_to_string(list_transform(fields, lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS leaf,
    sha256(array_to_string(list_transform(CASE WHEN xor(crc, 4294967295) % 7 = 0 AND fields[4] IS NOT NULL THEN forged ELSE fields END,
      lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS found
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM h),
t AS (SELECT grp, 0 AS lvl, i, leaf AS node, n FROM p
  UNION ALL SELECT grp, lvl + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, lvl, i // 2, n),
s AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp = '-' DESC, grp) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS node, n FROM s
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
f AS (SELECT rid, grp, 0 AS lvl, i, n, found AS x, '' AS proof FROM p
  UNION ALL SELECT rid, f.grp, f.lvl + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN t.node || x ELSE x || coalesce(t.node, '') END),
    proof || coalesce(t.node, '') FROM f LEFT JOIN t ON t.grp = f.grp AND t.lvl = f.lvl AND t.i = xor(f.i, 1) WHERE f.n > 1),
g AS (SELECT rid, s.subroot, 0 AS lvl, s.i, s.n, x, proof FROM f JOIN s USING (grp) WHERE f.n = 1
  UNION ALL SELECT rid, subroot, g.lvl + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN g.i % 2 = 1 THEN u.node || x ELSE x || coalesce(u.node, '') END),
    proof || coalesce(u.node, '') FROM g LEFT JOIN u ON u.lvl = g.lvl AND u.i = xor(g.i, 1) WHERE g.n > 1)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = u.node AS verified
FROM g JOIN p USING (rid) JOIN u ON u.n = 1 WHERE g.n = 1
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
g AS (SELECT rid, place, line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN f USING (key)),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')
  AS kept FROM g GROUP BY rid)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN t USING (rid)
"""


#: SQL of the operators that it can express; the others are tested against brute force, round trips or held-out rows.
SQL: dict[str, str] = {
    "op1_quality_rules": _OP1, "op3_exact_dedup": _OP3, "op4_ngram_jaccard": _OP4, "op5_mixing": _OP5, "op6_warc": _OP6, "op7_suffix_dedup": _OP7,
    "op10_license_scan": _op10(), "op11_merkle_manifest": _OP11, "op13_line_dedup": _OP13,
}
