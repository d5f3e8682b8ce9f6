"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from versio.llm import decontaminate as dc
from versio.llm import fill_middle as fm
from versio.llm import licenses as lic
from versio.llm import line_dedup as ld
from versio.llm import pieces as sp
from versio.llm import pii
from versio.llm import secret_scan
from versio.llm import simhash as sh
from versio.llm import spelling
from versio.llm import substring_dedup as sd
from versio.llm import token_counts as tc
from versio.llm import topk
from versio.llm import toxicity as tox
from versio.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dc.digest(dc.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.digest(sd.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("query", "query_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tox.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= tox.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ld.decisions(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.digest(lic.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.digest(sh.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.digest(sp.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.digest(fm.restore(fm.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tc.digest(tc.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP1_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, coalesce(w, []) AS w FROM low),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
OP8_SQL = r"""
WITH src AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
ln AS (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n FROM (SELECT *, regexp_extract_all(l, '[^ 	-
]+') AS w FROM src)),
d AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min({'d': doc_id, 'i': i}) AS f FROM ln WHERE n > 0 GROUP BY s),
v AS (
  SELECT s, f, k, array_to_string(w[1:k - 1] || w[k + 1:], ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM d WHERE n >= 11)),
near AS (
  SELECT s FROM (SELECT s, f, min(f) OVER (PARTITION BY v, k) AS m FROM v) WHERE m < f
  UNION SELECT v.s FROM v JOIN d ON v.v = d.s AND d.n >= 11 WHERE d.f < v.f
  UNION SELECT d.s FROM v JOIN d ON v.v = d.s AND d.n >= 11 WHERE v.f < d.f),
flag AS (
  SELECT ln.doc_id, ln.l, ln.i, ln.n, ln.n > 0 AND (near.s IS NOT NULL OR {'d': ln.doc_id, 'i': ln.i} > d.f) AS gone
  FROM ln LEFT JOIN d ON ln.s = d.s LEFT JOIN near ON near.s = ln.s),
per AS (
  SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (gone) AS removed FROM flag GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(removed, '') AS removed
FROM (SELECT doc_id FROM documents) LEFT JOIN per USING (doc_id)
"""

OP11_SQL = r"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h FROM s),
c AS (
  SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

# crc32 is written out: its table from the polynomial, then a fold over the bytes of each distinct key and run.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for b in range(256)] AS t),
runs AS (
  SELECT doc_id, r, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS r
    FROM documents) GROUP BY doc_id, r),
hx AS (SELECT r, c, hex(doc_id || ':' || r) AS x FROM runs),
bt AS (
  SELECT r, c, [(instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 for i in range(length(x) // 2)] AS y FROM hx),
hs AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295, y), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM bt, crc),
ws AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM hs),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM ws WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.k = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.k = v.word),
g AS (SELECT x AS word, count(*) AS n_near, first({'w': y, 'n': v.n} ORDER BY v.n DESC, y) AS best FROM e JOIN v ON v.word = e.y GROUP BY x),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN best.w END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN g ON g.word = v.word),
w AS (SELECT word, word AS tip FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.tip AS root, f.n, f.n_near, f.form_n
FROM f JOIN w ON w.word = f.word JOIN f l ON l.word = w.tip WHERE l.form IS NULL
"""

#: The templates as rows: a name, and its text quoted for SQL.
NOTICES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(lic.TEMPLATES))

OP9_SQL = r"""
WITH t AS (
  SELECT k, name, regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (VALUES NOTICES) v(k, name, txt)),
tb AS (SELECT k, name, b, count(*) AS c, any_value(n) AS n FROM (
  SELECT k, name, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)) GROUP BY k, name, b),
ln AS (
  SELECT doc_id, i, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
wd AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) AS q
  FROM (SELECT doc_id, i, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM ln)),
bg AS (
  SELECT doc_id, i AS f, lead(i) OVER o AS l, q, x || ' ' || lead(x) OVER o AS b FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
hit AS (SELECT doc_id, k, name, f, l, q, b, c, n FROM bg JOIN tb USING (b)),
win AS (
  SELECT a.doc_id, a.k, a.name, a.n, a.f, a.q AS s, z.l, z.q AS e,
    CASE WHEN row_number() OVER (PARTITION BY a.doc_id, a.k, a.q, z.b ORDER BY z.q) <= z.c THEN 1 ELSE 0 END AS one
  FROM hit a JOIN hit z ON a.doc_id = z.doc_id AND a.k = z.k AND z.q BETWEEN a.q AND a.q + 1.5001 * a.n),
dice AS (
  SELECT doc_id, name, f, l, s, e, CAST(2 * sum(one) OVER (PARTITION BY doc_id, k, s ORDER BY e) AS DOUBLE) / (e - s + 1 + n) AS dice FROM win),
best AS (SELECT * FROM dice WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY dice DESC, s, e) = 1),
per AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names,
    first({'a': name, 'b': dice, 'c': f, 'd': l} ORDER BY dice DESC, name) AS x FROM best GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, x.a AS best_license, x.b AS best_dice,
  CAST(x.c AS INTEGER) AS best_first, CAST(x.d AS INTEGER) AS best_last
FROM (SELECT doc_id FROM documents) LEFT JOIN per USING (doc_id)
""".replace("NOTICES", NOTICES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_pii": op3_pii,
        "op4_secret_scan": op4_secret_scan,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_toxicity": op6_toxicity,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_line_dedup": op8_line_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_counts": op12_token_counts,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1_SQL,
        "op5_exact_top_k": OP5_SQL,
        "op8_line_dedup": OP8_SQL,
        "op9_license_scan": OP9_SQL,
        "op11_fill_in_middle": OP11_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
