"""Text cleaning and tf-idf features in long form."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.columns import as_double, quoted
from plumbline.functions.ordered import running_sums
from plumbline.functions.session import cut_lineage
from plumbline.functions.skew import split_join
from plumbline.functions.words import LINK, MAIL, SPACE, SPECIAL, STOP_WORDS, TAG, stripped

MIN_DOCS = 2
MATRIX_TERMS = 5000          # text columns of an assembled matrix
MOST_BROADCAST_TERMS = 20_000
TEXTS_AT_ONCE = 500          # of an Arrow batch


def clean_text(c: Column) -> Column:
    """Tags, links, addresses, special characters and digits become blanks; lower case, single blanks."""
    c = F.coalesce(c, F.lit(""))
    for pattern in (TAG, LINK, MAIL, SPECIAL, r"\p{Nd}+"):
        c = F.regexp_replace(c, pattern, " ")
    return F.regexp_replace(stripped(F.lower(c)), f"[{SPACE}]+", " ")


def kept_tokens(cleaned: Column) -> Column:
    """Tokens longer than two characters that are not stop words."""
    return F.filter(F.split(cleaned, " "), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def filter_tokens(cleaned: Column) -> Column:
    return F.array_join(kept_tokens(cleaned), " ")


def one_two_grams(tokens: Column) -> Column:
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
                       F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def counted(terms: Column) -> Column:
    """``array<struct<term, tf>>``: the distinct entries of an array and how often each occurs.

    Sorted once; the lengths of the runs are the counts.
    """
    ordered = F.array_sort(terms)

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(t) + 1))
        return F.transform(F.array(starts), lambda s: F.zip_with(
            s, ends(s), lambda a, b: F.struct(F.get(t, a - 1).alias("term"), (b - a).cast("bigint").alias("tf"))))[0]

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.transform(F.array(ordered), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))[0]


def _counts_of_texts(batches):
    """Words and word pairs of each text with their counts, from its words; few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            sizes = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words, row = part.column(1).flatten(), np.repeat(np.arange(len(sizes)), sizes)
            goes_on = row[1:] == row[:-1]
            pairs = pc.binary_join_element_wise(words.slice(0, max(0, len(words) - 1)).filter(pa.array(goes_on)),
                                                words.slice(1).filter(pa.array(goes_on)), pa.scalar(" ", words.type))
            terms = pa.concat_arrays([words, pairs]).dictionary_encode()
            n_terms = max(1, len(terms.dictionary))
            cells, tf = np.unique(np.concatenate([row, row[1:][goes_on]]) * n_terms + terms.indices.to_numpy(), return_counts=True)
            of, term = np.divmod(cells, n_terms)
            ends = np.cumsum(np.bincount(of, minlength=len(sizes)))
            entries = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], ["term", "tf"])
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, entries)], ["key", "terms"])


def term_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms``: one row per text with its words and word pairs and their counts, written once."""
    words = df.select(quoted(key).alias("key"), kept_tokens(clean_text(quoted(text).cast("string"))).alias("words"))
    vectors = words.mapInArrow(
        _counts_of_texts, f"key {words.schema['key'].dataType.simpleString()}, terms array<struct<term:string,tf:bigint>>")
    return cut_lineage(vectors.select(F.col("key").alias(key), "terms"))


def vocabulary(vectors: DataFrame, max_terms: int | None = None, min_docs: int = MIN_DOCS) -> DataFrame:
    """``term, index, df``: terms found in enough texts, numbered alphabetically.

    Only totals per term are shuffled, combined in each task first.  With
    ``max_terms`` a distributed top-k keeps the most frequent ones.
    """
    top = (vectors.select(F.inline("terms")).groupBy("term")
           .agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_docs))
    if max_terms is not None:
        top = top.orderBy(F.desc("total"), "term").limit(max_terms)
    return running_sums(top, [], ["term"], {"index": F.lit(1).cast("bigint")}).select(
        "term", F.col("index").cast("int").alias("index"), "df")


def _weigh(key_type: pa.DataType, terms: list[str], indexes: list[int], idf: list[float]):
    """Weights of whole texts: all terms of a text are in its row, so its length is known there."""
    def weigh(batches):
        known, number, weight_of = pa.array(terms, pa.string()), np.array(indexes, np.int32), np.array(idf)
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            vectors = batch.column(1)
            cells = vectors.flatten()
            row = np.repeat(np.arange(len(vectors)), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            place = pc.index_in(cells.field("term"), known)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            at = place.drop_null().to_numpy()
            row, tf = row[found], cells.field("tf").to_numpy(zero_copy_only=False)[found]
            w = (1 + np.log(tf)) * weight_of[at]
            length = np.sqrt(np.bincount(row, w * w, len(vectors)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)).cast(key_type), known.take(pa.array(at)), pa.array(number[at]),
                 pa.array(w / length[row])], names=["key", "term", "index", "weight"])
    return weigh


def tfidf_features(df: DataFrame, key: str, text: str, max_terms: int | None = MATRIX_TERMS,
                   min_docs: int = MIN_DOCS) -> DataFrame:
    """``key, term, index, weight``: sublinear tf times smoothed idf, unit length per text.

    ``key`` identifies a text.  ``max_terms`` keeps the most frequent terms (5,000
    unless told; None keeps all).  Up to ``MOST_BROADCAST_TERMS`` terms travel to
    the texts and no (text, term) row is shuffled; more terms meet the texts in a
    join on the term, whose frequent terms are split over tasks, and one more
    shuffle by text gives the lengths.
    """
    vectors = term_vectors(df, key, text)
    n = df.count()
    words = vocabulary(vectors, max_terms, min_docs)
    if max_terms is not None and max_terms <= MOST_BROADCAST_TERMS:
        known = words.collect()
        idf = [math.log((1 + n) / (1 + r["df"])) + 1 for r in known]
        weigh = _weigh(to_arrow_type(vectors.schema[key].dataType), [r["term"] for r in known],
                       [r["index"] for r in known], idf)
        plain = vectors.select(quoted(key).alias("key"), "terms")
        out = plain.mapInArrow(
            weigh, f"key {plain.schema['key'].dataType.simpleString()}, term string, index int, weight double")
        return out.select(F.col("key").alias(key), "term", "index", "weight")
    words = cut_lineage(words)
    pairs = vectors.select(quoted(key), F.inline("terms"))
    counts = words.select("term", F.col("df").alias("_n"))
    weighted = split_join(pairs, words, ["term"], quoted(key), counts=counts).withColumn(
        "w", (1 + F.ln("tf")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(quoted(key))))
    return weighted.select(quoted(key), "term", "index", (F.col("w") / norm).alias("weight"))


def assemble_features(df: DataFrame, key: str, text: str, numbers: list[str],
                      max_terms: int = MATRIX_TERMS) -> DataFrame:
    """``key, index, value``: the sparse matrix of text weights and numbers (null is 0) side by side.

    Numbers follow the text terms; zeros are not stored.
    """
    words = tfidf_features(df, key, text, max_terms)
    cells = F.array(*[F.struct(F.lit(max_terms + i).alias("index"),
                               F.coalesce(as_double(c), F.lit(0.0)).alias("value"))
                      for i, c in enumerate(numbers)])
    dense = df.select(quoted(key), F.inline(cells)).filter("value <> 0")
    return words.select(quoted(key), "index", F.col("weight").alias("value")).unionByName(dense)
