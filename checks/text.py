"""Text operators."""

from checks.patterns import DIGIT, LINK, SPACE, SPECIAL, TAG
from checks.registry import on, query, union
from plumbline.functions.words import STOP_WORDS
from plumbline.operators import text

STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + ")"
WORDS = f"len(regexp_extract_all(s, '[^{SPACE}]+'))"
STRIPPED = f"regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def tokens_sql(table, column="text", extra=""):
    return f"""tok AS (SELECT * FROM (SELECT {extra} unnest(string_split_regex(
  lower(regexp_replace({column}, '{TAG}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}''-]+')) AS token FROM {table})
  WHERE regexp_matches(token, '^\\p{{L}}+$'))"""


DETECT = f"""
SELECT '@n' AS "column", round(avg(length(s)), 1) AS avg_length,
  round(count(DISTINCT s) / count(s), 3) AS unique_ratio
FROM (SELECT @c AS s FROM {{table}})
HAVING (avg(length(s)) > 20 OR (avg(length(s)) > 15 AND count(DISTINCT s) / count(s) > 0.7))
  AND count(DISTINCT s) / count(s) > 0.1
  AND NOT (count(DISTINCT s) / count(s) > 0.8 AND avg({WORDS}) < 8 AND avg(length(s)) < 50
           AND stddev_samp({WORDS}) < 3)"""


@query("h1_free_text_detection", on("docs_labeled", body=union(
    DETECT.replace("{table}", "docs_labeled"), ["text", "lang", "source"])))
def h1(t):
    return text.free_text_detection(t("docs_labeled"))


@query("h1_free_text_detection_pages", on("pages_text", body=union(
    DETECT.replace("{table}", "pages_text"), ["text", "maybe_url"])))
def h1_pages(t):
    return text.free_text_detection(t("pages_text"))


def lengths_sql(table, columns):
    return union(f"""SELECT '@n' AS "column", round(avg({WORDS}), 2) AS avg_words, round(avg(length(s)), 2) AS avg_chars,
  max({WORDS})::INT AS max_words, min({WORDS})::INT AS min_words FROM (SELECT @c AS s FROM {table})""", columns)


@query("h2_text_lengths", lengths_sql("documents", ["text"]))
def h2(t):
    return text.text_lengths(t("documents"), ["text"])


@query("h2_text_lengths_pages", on("pages_text", body=lengths_sql("pages_text", ["text", "maybe_url"])))
def h2_pages(t):
    return text.text_lengths(t("pages_text"), ["text", "maybe_url"])


@query("h3_tokenize", on(more=tokens_sql("documents"), body="""
SELECT 'text' AS "column", token, count(*) AS n FROM tok GROUP BY token"""))
def h3(t):
    return text.token_counts(t("documents"), ["text"])


VOCAB = """
SELECT 'text' AS "column", count(DISTINCT token) AS vocab_size, count(*) AS n_tokens,
  round(count(DISTINCT token) / count(*), 4) AS lexical_diversity FROM tok"""


@query("h4_vocab_diversity", on(more=tokens_sql("documents"), body=VOCAB))
def h4(t):
    return text.vocabulary(text.token_counts(t("documents"), ["text"]))


@query("h4_vocab_diversity_pages", on("pages_text", more=tokens_sql("pages_text"), body=VOCAB))
def h4_pages(t):
    return text.vocabulary(text.token_counts(t("pages_text"), ["text"]))


@query("h5_top_words", on(more=tokens_sql("documents"), body=f"""
SELECT 'text' AS "column", (row_number() OVER (ORDER BY count(*) DESC, token))::INT AS rank, token AS word, count(*) AS n
FROM tok WHERE token NOT IN {STOPS} GROUP BY token ORDER BY rank LIMIT 15"""))
def h5(t):
    return text.top_words(text.token_counts(t("documents"), ["text"]))


def quality_sql(table, columns):
    return union(f"""SELECT '@n' AS "column", round(avg(({STRIPPED} = '')::INT), 4) AS empty_ratio,
  round(avg(regexp_matches(s, '{LINK}')::INT), 4) AS url_ratio,
  round(avg(regexp_matches(s, '{DIGIT}')::INT), 4) AS number_ratio,
  round(avg(len(regexp_extract_all(s, '{SPECIAL}')) / greatest(length(s), 1)), 4) AS special_char_ratio
FROM (SELECT @c AS s FROM {table})""", columns)


@query("h6_text_quality", quality_sql("documents", ["text"]))
def h6(t):
    return text.text_quality(t("documents"), ["text"])


@query("h6_text_quality_pages", on("pages_text", body=quality_sql("pages_text", ["text", "maybe_url"])))
def h6_pages(t):
    return text.text_quality(t("pages_text"), ["text", "maybe_url"])


@query("h7_duplicate_text_ratio", f"""
SELECT 'text' AS "column", round(1 - count(DISTINCT lower({STRIPPED})) / count(s), 4) AS duplicate_ratio
FROM (SELECT text AS s FROM documents)""")
def h7(t):
    return text.duplicate_texts(t("documents"), ["text"])


@query("h8_vectorization_advice", on(more=tokens_sql("documents"), body="""
SELECT 'text' AS "column", count(DISTINCT token) AS vocab_size,
  CASE WHEN count(DISTINCT token) < 100 THEN 'Vocabulary too small for embeddings. Use simple TF-IDF or bag-of-words.'
    WHEN count(DISTINCT token) < 1000 THEN 'Small vocabulary. TF-IDF recommended.'
    WHEN (SELECT count(text) FROM documents) < 10000
      THEN 'Medium dataset. TF-IDF or fine-tuned embeddings (Word2Vec, FastText).'
    ELSE 'Large dataset. Consider BERT/sentence-transformers for best results.' END AS recommendation,
  count(DISTINCT token) >= 500 AS suitable_for_embeddings FROM tok"""))
def h8(t):
    docs = t("documents")
    return text.vectorization_advice(docs, ["text"], text.token_counts(docs, ["text"]))


@query("h9_per_class_text", on("docs_labeled", body=f"""
SELECT 'text' AS "column", quality::VARCHAR AS "class", count(s) AS n, round(avg({WORDS}), 2) AS avg_words,
  round(avg(length(s)), 2) AS avg_chars FROM (SELECT text AS s, quality FROM docs_labeled) GROUP BY quality"""))
def h9(t):
    return text.per_class_lengths(t("docs_labeled"), ["text"], "quality")


@query("h9_per_class_words", on("docs_labeled", more=tokens_sql("docs_labeled", extra="quality,"), body=f"""
SELECT * FROM (SELECT 'text' AS "column", quality::VARCHAR AS "class",
  (row_number() OVER (PARTITION BY quality ORDER BY count(*) DESC, token))::INT AS rank, token AS word, count(*) AS n
  FROM tok WHERE token NOT IN {STOPS} GROUP BY quality, token) WHERE rank <= 10"""))
def h9_words(t):
    return text.per_class_words(t("docs_labeled"), ["text"], "quality")
