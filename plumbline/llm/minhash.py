"""Near-duplicate documents by bottom-k sketches of one hash function.

A document keeps the k smallest hashes of its shingles.  Inverted lists of kept
values give candidate pairs, the bottom k of the united sketches estimate their
similarity, and the full sets decide.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, stored

WIDTH, PERCENT = 5, 80      # words of a shingle, least similarity in percent
SKETCH = 64                 # hashes kept of a document
# An estimate under FLOOR rules a pair out.  At a true similarity of 0.8 that
# happens to about one pair in 300,000 (binomial, 64 draws), above it to fewer.
FLOOR = 0.55
PIVOT_ROUNDS = 2
PARITY_WORDS = 8            # 64-bit words of the parity map of a set

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words seen so far, emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Fewer words than ``width`` make one shingle of all; none make none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    span = min(width, len(words))
    rolled = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        rolled = _mix(rolled * _MULTIPLY + h[k:len(h) - span + 1 + k])
    return np.unique(rolled.view(np.int64))


def _sketches(width: int, size: int):
    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes) for t in batch.column(1).to_pylist()]
            kept = [s[:size] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(offsets, np.concatenate([*kept, np.empty(0, np.int64)]))],
                ["id", "n", "digest", "sketch"])
    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether the set holds an odd number of them, as 64-bit words.

    Two sets differ in at least as many members as their maps differ in bits.
    """
    place = (shingles.view(np.uint64) * _MULTIPLY) >> np.uint64(64 - 9)
    odd = np.bincount(place.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full_sets(width: int):
    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 500):
                sets = [shingle_set(t, width, hashes) for t in texts[start:start + 500]]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, 500),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, np.concatenate([*sets, np.empty(0, np.int64)])),
                    pa.array([parity(s) for s in sets], pa.list_(pa.int64()))],
                    ["id", "digest", "shingles", "parity"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    percent: int = PERCENT, size: int = SKETCH, floor: float = FLOOR,
                    pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """``(id, n, component)`` for every row: set size and smallest id reachable over links.

    Documents link when ``100 * |A & B| >= percent * |A | B|``.  Documents with
    one set are one class from the start.  Of a sketch only the rarest values are
    listed, as many as a linked partner must share one of (prefix filter), so
    values common to many unlike documents make no lists.  Members of a list are
    first held against a few pivots, the most central one before all, which joins
    a large group of copies without looking at its pairs.  Then only pairs are
    formed that are still in different components and whose sizes and parity maps
    allow a link, each at its smallest common value alone; a map's bound is exact, so none is lost.  Rows without an id, and empty sets,
    link with nothing and are their own component.  Rows that repeat an id give
    a row each.
    """
    least = percent / 100
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                  .mapInArrow(_sketches(width, size), "id long, n long, digest binary, sketch array<long>"), "sketches")
    classes = stored(rows.where("id is not null and n > 0").groupBy("digest")
                     .agg(F.min(F.struct("id", "n", "sketch")).alias("c"))
                     .select("digest", "c.id", "c.n", "c.sketch"), "classes")

    entries = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("docs")).where("docs > 1")
    m = F.least(F.col("n"), F.lit(size))
    share = F.when(F.col("n") <= least * size, least).otherwise(floor)
    # values of one document only are its rarest; they fill the prefix first
    room = m - F.ceil(share * m - 1e-9) + 1 - (m - F.size("values"))
    index = stored(entries.join(shared, "value").groupBy("id", "n")
                   .agg(F.sort_array(F.collect_list(F.struct("docs", "value"))).alias("values"))
                   .select("id", "n", F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v["docs"]).alias("weight"),
                           F.explode(F.slice("values", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("e"))
                   .select("id", "n", "weight", "e.value"), "lists")
    listed = index.select("id").distinct()
    sets = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                  .join(listed, "id", "left_semi")
                  .mapInArrow(_full_sets(width), "id long, digest binary, shingles array<long>, parity array<long>")
                  .join(classes.select("id", "digest"), ["id", "digest"], "left_semi")
                  .dropDuplicates(["id"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        for at in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("id").alias(at), F.col("n").alias("n_" + at),
                                              F.col("sketch").alias("s_" + at)), at)
        united = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, size)
        pairs = pairs.withColumn("u", united).where(
            F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b"))) >= floor * F.size("u"))
        pairs = pairs.select("a", "b", "n_a", "n_b")
        for at in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(at), F.col("shingles").alias("s_" + at)), at)
        both = F.size(F.array_intersect("s_a", "s_b"))
        return stored(pairs.withColumn("both", both)
                      .where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
                      .select("a", "b"), "links")

    def alike(x, y):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    links = None
    members = index.withColumn("component", F.col("id"))
    for turn in range(pivot_rounds):
        # first the member that holds most of what the others hold, then some by hash
        rank = F.col("weight") if turn == 0 else F.xxhash64("id", F.pmod("value", F.lit(4)), F.lit(turn))
        pivots = members.groupBy("value").agg(F.max(F.struct(
            rank.alias("rank"), F.col("id").alias("p"), F.col("n").alias("p_n"),
            F.col("component").alias("p_component"))).alias("v")).select("value", "v.*")
        found = linked(members.join(pivots, "value")
                       .where((F.col("component") != F.col("p_component")) & alike(F.col("n"), F.col("p_n")))
                       .select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
        links = found if links is None else links.unionAll(found)
        if turn < pivot_rounds - 1:     # the least neighbour will do: equal ones are connected
            label = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
        else:
            label = components(links).withColumnRenamed("node", "id")
        label = stored(label, "labels")
        members = index.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = stored(members, "members")
    mixed = members.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x != y").select("value")
    words = range(PARITY_WORDS)
    open_ = stored(members.join(mixed, "value", "left_semi"), "open")
    # a pair meets at its smallest common value alone, not once for each
    lists = open_.groupBy("id").agg(F.collect_list("value").alias("listed"))
    left = (open_.join(sets.select("id", *[F.col("parity")[k].alias(f"x{k}") for k in words]), "id").join(lists, "id")
            .withColumn("before", F.filter("listed", lambda v: v < F.col("value"))))
    right = left.select("value", F.col("id").alias("p"), F.col("n").alias("p_n"), F.col("component").alias("p_component"),
                        F.col("before").alias("p_before"), *[F.col(f"x{k}").alias(f"y{k}") for k in words])
    # linked sets differ in no more than this share of their members
    differ = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in words), F.lit(0))
    found = linked(left.join(right, "value")
                   .where((F.col("component") != F.col("p_component")) & (F.col("id") < F.col("p"))
                          & alike(F.col("n"), F.col("p_n")) & ~F.arrays_overlap("before", "p_before")
                          & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("p_n"))))
                   .select(F.col("id").alias("a"), F.col("p").alias("b")).distinct())
    if not found.isEmpty():
        label = components(label.select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(found)) \
            .withColumnRenamed("node", "id")

    named = classes.select("digest", "id").join(label, "id", "left") \
        .select("digest", F.coalesce("component", "id").alias("component"))
    return rows.select("id", "n", "digest").join(named, "digest", "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component"))
        .otherwise(F.col("id")).alias("component"))


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """One row per document, shingles of four words."""
    return near_duplicates(docs, width=4).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of smallest id.

    Rows that repeat an id count as copies and leave one; rows without an id stay.
    """
    found = stored(near_duplicates(docs, **options), "groups")
    out = docs.join(found.where("id != component").select(F.col("id").alias("doc_id")).distinct(),
                    "doc_id", "left_anti")
    if not found.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(out.where("doc_id is null"))
    return out.select(*docs.columns)
