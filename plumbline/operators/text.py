"""Free-text detection and text statistics over whole texts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (aggregate_long, as_text, kinds, unfold, union_all,
                                         word_count)
from plumbline.functions.frequency import digest, distinct_counts
from plumbline.functions.words import DIGIT, LINK, SPECIAL, STOP_WORDS, stripped, tokens
from plumbline.operators.profile import text_shape

# Advice by vocabulary size and number of texts.
ADVICE = {
    "tiny": "Vocabulary too small for embeddings. Use simple TF-IDF or bag-of-words.",
    "small": "Small vocabulary. TF-IDF recommended.",
    "medium": "Medium dataset. TF-IDF or fine-tuned embeddings (Word2Vec, FastText).",
    "large": "Large dataset. Consider BERT/sentence-transformers for best results.",
}


def free_text_detection(df: DataFrame, target: str | None = None) -> DataFrame:
    """``column, avg_length, unique_ratio`` of the text columns; shares are over non-null values."""
    names = [c for c, k in kinds(df).items() if k in ("string", "datetime") and c != target]
    facts = text_shape(df, names).join(F.broadcast(distinct_counts(df, names)), "column")
    ratio = F.col("n_distinct") / F.col("n")
    text = ((F.col("length") > 20) | ((F.col("length") > 15) & (ratio > 0.7))) & (ratio > 0.1)
    steady = F.coalesce((ratio > 0.8) & (F.col("words") < 8) & (F.col("length") < 50)
                        & (F.col("words_std") < 3), F.lit(False))
    return (facts.filter(text & ~steady)
            .select("column", F.round("length", 1).alias("avg_length"),
                    F.round(ratio, 3).alias("unique_ratio")))


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, avg_words, avg_chars, max_words, min_words``."""
    per = {}
    for c in columns:
        s = as_text(df, c)
        w = word_count(s)
        per[c] = {"avg_words": F.round(F.avg(w), 2), "avg_chars": F.round(F.avg(F.length(s)), 2),
                  "max_words": F.max(w), "min_words": F.min(w)}
    return aggregate_long(df, per)


def token_counts(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """``column[, class], token, n``: how often each token occurs."""
    frames, extra = [], [as_text(df, by).alias("class")] if by else []
    for c in columns:
        frames.append(df.select(F.lit(c).alias("column"), *extra,
                                F.explode(tokens(as_text(df, c))).alias("token")))
    keys = ["column", *(["class"] if by else []), "token"]
    rows = union_all(frames)
    if by:
        rows = rows.filter("class is not null")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``column, vocab_size, n_tokens, lexical_diversity`` from ``token_counts``."""
    return (counts.groupBy("column")
            .agg(F.count("*").alias("vocab_size"), F.sum("n").alias("n_tokens"))
            .withColumn("lexical_diversity",
                        F.round(F.col("vocab_size") / F.col("n_tokens"), 4)))


def top_words(counts: DataFrame, k: int = 15) -> DataFrame:
    """``column[, class], rank, word, n``: most frequent non-stopwords, ties by word."""
    groups = [c for c in ("column", "class") if c in counts.columns]
    best = Window.partitionBy(*groups).orderBy(F.desc("n"), "token")
    return (counts.filter(~F.col("token").isin(STOP_WORDS))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(*groups, "rank", F.col("token").alias("word"), "n"))


def text_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, empty_ratio, url_ratio, number_ratio, special_char_ratio``."""
    per = {}
    for c in columns:
        s = as_text(df, c)
        special = F.regexp_count(s, F.lit(SPECIAL)) / F.greatest(F.length(s), F.lit(1))
        share = lambda flag: F.round(F.avg(flag.cast("int")), 4)
        per[c] = {"empty_ratio": share(stripped(s) == ""), "url_ratio": share(s.rlike(LINK)),
                  "number_ratio": share(s.rlike(DIGIT)),
                  "special_char_ratio": F.round(F.avg(special), 4)}
    return aggregate_long(df, per)


def duplicate_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, duplicate_ratio``: share of texts that repeat one seen (case and ends ignored).

    Only a 128-bit key of each text is shuffled.
    """
    rows = [[F.lit(c), F.when(as_text(df, c).isNotNull(),
                              digest(F.lower(stripped(as_text(df, c)))))] for c in columns]
    return (unfold(df, rows, ["column", "key"]).filter("key is not null")
            .groupBy("column", "key").agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(F.round(1 - F.count("*") / F.sum("n"), 4).alias("duplicate_ratio")))


def vectorization_advice(df: DataFrame, columns: list[str], counts: DataFrame) -> DataFrame:
    """``column, vocab_size, recommendation, suitable_for_embeddings``."""
    sizes = aggregate_long(df, {c: {"n_texts": F.count(as_text(df, c))} for c in columns})
    v = F.col("vocab_size")
    advice = (F.when(v < 100, ADVICE["tiny"]).when(v < 1000, ADVICE["small"])
              .when(F.col("n_texts") < 10_000, ADVICE["medium"]).otherwise(ADVICE["large"]))
    return (sizes.join(F.broadcast(vocabulary(counts)), "column", "left")
            .withColumn("vocab_size", F.coalesce("vocab_size", F.lit(0).cast("bigint")))
            .select("column", "vocab_size", advice.alias("recommendation"),
                    (v >= 500).alias("suitable_for_embeddings")))


def per_class_lengths(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``column, class, n, avg_words, avg_chars``."""
    rows = [[F.lit(c), word_count(as_text(df, c)), F.length(as_text(df, c))] for c in columns]
    return (unfold(df, rows, ["column", "w", "l"], [as_text(df, by).alias("class")])
            .filter("class is not null and l is not null")
            .groupBy("column", "class")
            .agg(F.count("*").alias("n"), F.round(F.avg("w"), 2).alias("avg_words"),
                 F.round(F.avg("l"), 2).alias("avg_chars")))


def per_class_words(df: DataFrame, columns: list[str], by: str, k: int = 10) -> DataFrame:
    """``column, class, rank, word, n``."""
    return top_words(token_counts(df, columns, by), k)


def text_report(df: DataFrame, columns: list[str], target: str | None = None) -> dict[str, DataFrame]:
    """All text results of the given columns."""
    counts = token_counts(df, columns)
    out = {
        "text_lengths": text_lengths(df, columns), "text_quality": text_quality(df, columns),
        "duplicate_texts": duplicate_texts(df, columns), "vocabulary": vocabulary(counts),
        "top_words": top_words(counts),
        "vectorization_advice": vectorization_advice(df, columns, counts),
    }
    if target is not None:
        out["per_class_lengths"] = per_class_lengths(df, columns, target)
        out["per_class_words"] = per_class_words(df, columns, target)
    return out
