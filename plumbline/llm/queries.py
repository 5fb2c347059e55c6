"""Queries of this subpackage and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import centroids, html, minhash, ngrams, packing, private, quality, secrets, segment, toxic, turns, vectors, warc
from plumbline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(read(spark, folder, "embeddings")).drop("recall")


def op2_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicate_table(read(spark, folder, "documents"))


def op3_sampled_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return segment.sample_table(read(spark, folder, "documents"))


def op4_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_table(read(spark, folder, "documents"))


def op5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return private.surrogate_table(read(spark, folder, "documents"), private.session_key(spark))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_table(read(spark, folder, "documents"))


def op6_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(read(spark, folder, "documents"))


def op8_host_paths(spark: SparkSession, folder: str) -> DataFrame:
    return html.page_table(read(spark, folder, "pages"))


def op9_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_table(read(spark, folder, "pages"))


def op10_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.score_texts(read(spark, folder, "documents"))


def op11_toxicity_filters(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_centroid_heaps(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.centroid_clusters(read(spark, folder, "embeddings"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turns.conversation_trie(read(spark, folder, "conversations"))


for _query in (op1_vector_graph, op2_minhash_near_duplicates, op3_sampled_segmentations,
               op4_sum_of_squares_packing, op5_surrogates, op6_secret_ownership,
               op7_quality_rules, op8_host_paths, op9_warc_transactions, op10_ngram_scores,
               op11_toxicity_filters, op12_centroid_heaps, op13_conversation_trie):
    QUERIES[_query.__name__] = _query

# Words are [^\x20\x09-\x0D]+ after A-Z is lowered; links are confirmed on full sets.
ORACLES["op2_minhash_near_duplicates"] = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

# Bare base32 of SHA-1: 40 hex digits to 160 bits to 32 letters.
ORACLES["op9_warc_transactions"] = r"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(1, 41), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    (instr('0123456789abcdef', substr(hex, i, 1)) - 1) * 4 + 1, 4)), '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
    + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""

# Every pair of one label by brute force; the tables hold whole vectors of one length.
ORACLES["op1_vector_graph"] = r"""
WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""


def _lloyd_sql(k: int, rounds: int) -> str:
    """Every vector against every centroid in each round, a pair of CTEs per round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, i, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.vec_id, x.i, x.v, m.c, list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - m.v[j]) * (x.v[j] - m.v[j])))::BIGINT AS d
  FROM x, m{r} m) GROUP BY vec_id, i, v)""")
        if r < rounds:
            steps.append(f"""m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM m{r} m LEFT JOIN (
  SELECT c, list(s ORDER BY j) AS v FROM (SELECT c, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS s
    FROM a{r}, range(1, 65) t(j) GROUP BY c, j) GROUP BY c) n ON n.c = m.c)""")
    body = ",\n".join(steps)
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS i,
  list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM x
  ORDER BY sha256('3:' || vec_id) LIMIT {k}),
{body}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c
"""


ORACLES["op12_centroid_heaps"] = _lloyd_sql(8, 10)

# Rebuilt conversations as lists of (role, text); a node is a distinct list prefix.  crc32 bit by bit.
ORACLES["op13_conversation_trie"] = r"""
WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, conv_id - conv_id % 100 AS donor, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(0, 8), lambda z: 0::BIGINT)),
      lambda b, y: xor(b >> 1, 3988292384 * (b & 1))))) % 6 AS h FROM c),
q AS (SELECT h.conv_id, list_concat(coalesce(d.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN c d ON d.conv_id = h.donor),
p AS (SELECT q.conv_id, t.d, s[1:t.d] AS k, len(s) = t.d AS ends, s[t.d].t AS last FROM q, range(0, 100000) t(d) WHERE t.d <= len(s)),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(length(any_value(last)), 0) AS gain,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
kids AS MATERIALIZED (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
b AS (SELECT t.d, x.k[1:t.d] AS k, sum(x.gain) AS saved, sum((x.n_children = 0)::INT) AS n_leaves
      FROM x, range(0, 100000) t(d) WHERE t.d <= x.d GROUP BY 1, 2)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN b ON b.d = x.d AND b.k = x.k LEFT JOIN n u ON u.d = x.d - 1 AND u.k = x.k[1:x.d - 1]
"""
