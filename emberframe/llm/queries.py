"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import bpe, decontaminate, hmm, lcp, license, pii, simhash, suffix, tokens, topk, toxicity, variants, vector_codes
from emberframe.llm.common import read


def vocabulary() -> tuple[str, str]:
    """The production vocabulary's file and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), hmm.held_out())


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.digest(bpe.encode(read(spark, sf_dir, "documents"), path, pattern, with_bytes=True))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents")).drop("detections")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.deduplicated(read(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return tokens.suffix_sums(tokens.histogram(tokens.token_lengths(read(spark, sf_dir, "documents"), path, pattern)))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.code(read(spark, sf_dir, "embeddings")))


def op12_lcp_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.compared(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.word_counts(read(spark, sf_dir, "documents")).filter("n >= 2"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_hmm_score, op2_byte_bpe, op3_simhash, op4_decontaminate, op5_license_scan, op6_toxicity, op7_suffix_dedup, op8_token_counts, op9_pivot_topk, op10_pii, op11_vector_codes, op12_lcp_fingerprint, op13_spelling_variants)}


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) t
),
x AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) s) t),
m AS (SELECT DISTINCT r, i, x.n, item FROM x JOIN k ON k.key = x.key AND k.n = x.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) t GROUP BY r),
g AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN g ON g.r = d.r
"""


#: Bytes as pairs of hexadecimal digits, which stay cheap to cut. Width 400 is what is removed, 256 what counts as repeated.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
n AS (SELECT r, doc_id, b, length(b) // 2 AS n FROM d),
s AS (SELECT r, i, w, md5(substr(b, 2 * i - 1, 2 * w)) AS h FROM (SELECT r, b, w, unnest(range(1, n - w + 2)) AS i FROM n, (VALUES (400), (256)) x(w) WHERE n >= w) t),
k AS (SELECT r, i, w FROM s WHERE (w, h) IN (SELECT (w, h) FROM s GROUP BY w, h HAVING count(*) > 1)),
g AS (SELECT r, i, w, CASE WHEN i <= lag(i) OVER (PARTITION BY r, w ORDER BY i) + w THEN 0 ELSE 1 END AS fresh FROM k),
t AS (SELECT r, i, w, sum(fresh) OVER (PARTITION BY r, w ORDER BY i) AS run FROM g),
every AS (SELECT r, w, run, min(i) AS a, max(i) + w - 1 AS z FROM t GROUP BY r, w, run),
u AS (SELECT r, run, a, z FROM every WHERE w = 400),
m AS (SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS repeated FROM every WHERE w = 256 GROUP BY r),
v AS (SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS removed, count(*) AS spans FROM u GROUP BY r),
p AS (
  SELECT r, run, coalesce(lag(z) OVER (PARTITION BY r ORDER BY run), 0) + 1 AS f, a - 1 AS e FROM u
  UNION ALL SELECT u.r, max(run) + 1, max(z) + 1, max(n) FROM u JOIN n ON n.r = u.r GROUP BY u.r
),
x AS (SELECT p.r, string_agg(substr(b, 2 * f - 1, 2 * (e - f + 1)), '' ORDER BY run) AS kept FROM p JOIN n ON n.r = p.r WHERE e >= f GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN b ELSE coalesce(kept, '') END)) AS kept_sha256, coalesce(repeated, 0) AS n_repeated
FROM n LEFT JOIN v ON v.r = n.r LEFT JOIN x ON x.r = n.r LEFT JOIN m ON m.r = n.r
"""


def _assign(books: str) -> str:
    """Index and squared distance of each part's nearest entry."""
    d = " + ".join(f"(t.x{i} - b.x{i}) * (t.x{i} - b.x{i})" for i in range(4))
    return f"SELECT r, p, min(({d}) * 64 + e) % 64 AS e, min(({d}) * 64 + e) // 64 AS d FROM t JOIN {books} b USING (p) GROUP BY r, p"


def _moved(books: str, assigned: str) -> str:
    mean = ", ".join(f"CASE WHEN n IS NULL THEN b.x{i} ELSE (s{i} - (s{i} % n + n) % n) // n END AS x{i}" for i in range(4))
    sums = ", ".join(f"CAST(sum(x{i}) AS BIGINT) AS s{i}" for i in range(4))
    return f"SELECT b.p, b.e, {mean} FROM {books} b LEFT JOIN (SELECT p, e, count(*) AS n, {sums} FROM t JOIN {assigned} USING (r, p) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
t AS MATERIALIZED (SELECT r, p, {", ".join(f"v[4 * p + {i + 1}] AS x{i}" for i in range(4))} FROM v, range(0, 16) a(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x0, x1, x2, x3 FROM t WHERE r <= 64),
a1 AS MATERIALIZED ({_assign("b0")}),
b1 AS MATERIALIZED ({_moved("b0", "a1")}),
a2 AS MATERIALIZED ({_assign("b1")}),
b2 AS MATERIALIZED ({_moved("b1", "a2")}),
a3 AS MATERIALIZED ({_assign("b2")}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (r)
"""


#: k is the table of crc32, h a run's crc32, d the words without one of their letters: words are near if one is the other's d,
#: or both have the same d at the same place.
OP13_SQL = r"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) a(i)) b),
r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) t WHERE length(w) >= 7 GROUP BY doc_id, w),
h AS MATERIALIZED (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM (SELECT w, n, hex(encode(doc_id || ':' || w)) AS b FROM r) s, k),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w FROM h) s WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS x FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v) s),
p AS MATERIALIZED (SELECT DISTINCT a.w, b.w AS near, b.n FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.w <> b.w UNION SELECT d.w, v.w, v.n FROM d JOIN v ON v.w = d.x UNION SELECT v.w, d.w, d.n FROM d JOIN v ON v.w = d.x),
f AS MATERIALIZED (SELECT v.w AS word, CASE WHEN b.n >= 10 * v.n THEN b.near END AS form, v.n, coalesce(k, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN (SELECT w, near, n, count(*) OVER (PARTITION BY w) AS k, row_number() OVER (PARTITION BY w ORDER BY n DESC, encode(near)) AS rn FROM p) b ON b.w = v.w AND rn = 1),
g AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, f.n) AS root FROM (SELECT g.word, g.root, f.n FROM g JOIN f ON f.word = g.root) f GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON z.word = f.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_spelling_variants": OP13_SQL, "op11_vector_codes": OP11_SQL, "op7_suffix_dedup": OP7_SQL, "op4_decontaminate": OP4_SQL, "op9_pivot_topk": OP9_SQL}
