"""Prefix trie of conversations from whole sequences.

Every conversation is rebuilt (a shared opening, then its own turns).  The
key of a sequence is the sum, over its turns, of four 32-bit lanes of a hash of
(position, role, text); the key of a prefix is the running sum, so it comes from
sums that can be taken in parts, and a conversation of any length is spread over
tasks in chunks of ``CHUNK`` turns.  Identical conversations collapse into one
weighted sequence with the list of those that end there; only one of each is
unfolded into prefixes.  Sequences that are proper prefixes of another one fall
to an anti-join: what is left are the leaves.  All figures of a node are then
sums over the weighted sequences that pass it.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frequency import digest
from plumbline.functions.ordered import with_position
from plumbline.functions.skew import split_join
from plumbline.llm.common import Scratch

# consecutive turns of one conversation that one task sees together
CHUNK = 4096
# ids in one piece of an end list
IDS = 1024
KEY = ["k1", "k2", "k3", "k4"]
# most turns of another conversation's opening
OPENING = 5


def _lanes(position: Column) -> list[Column]:
    """Four numbers of 32 bits for a turn at a position; sums of 2^31 turns stay within a long."""
    a = F.xxhash64(F.lit(1), position, F.col("h1"), F.col("h2"))
    b = F.xxhash64(F.lit(2), position, F.col("h1"), F.col("h2"))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    return [a.bitwiseAND(low).alias("k1"), F.shiftrightunsigned(a, 32).alias("k2"),
            b.bitwiseAND(low).alias("k3"), F.shiftrightunsigned(b, 32).alias("k4")]


def _shared(conv: Column) -> Column:
    """Number of opening turns that a conversation takes from another one."""
    return F.crc32(conv.cast("string")) % (OPENING + 1)


def _per_chunk(conversations: DataFrame, last_chunk: str) -> DataFrame:
    """One row per (conversation, chunk): joins with turns then meet at most ``CHUNK`` turns per key."""
    return conversations.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk))).drop(last_chunk)


def _running(df: DataFrame, order: str, values: dict[str, str], backwards: bool = False) -> DataFrame:
    """Replace values by their sum up to and with the row (or from the row on) within ``conv``.

    Windows see one chunk; what other chunks add is a table of one row per further chunk.
    """
    turn = (lambda c: F.col(c).desc()) if backwards else F.col
    inside = Window.partitionBy("conv", "chunk").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy("conv", "chunk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    several = totals.groupBy("conv").agg(F.count("*").alias("_n")).where("_n > 1").select("conv")
    before = Window.partitionBy("conv").orderBy(turn("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.join(several, "conv").select(
        "conv", "chunk", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    summed = df.withColumns({f"_s_{k}": F.sum(v).over(inside) for k, v in values.items()})
    out = summed.join(offsets, ["conv", "chunk"], "left")
    return (out.withColumns({k: F.col(f"_s_{k}") + F.coalesce(f"_o_{k}", F.lit(0)) for k in values})
            .drop(*[f"_{p}_{k}" for p in "so" for k in values]))


def _id_pieces(batches):
    """Runs of one key in sorted rows, as texts of at most ``IDS`` ids."""
    held, ids = None, []

    def piece():
        return [*held, ids[0], ",".join(map(str, ids))]
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for *key, conv in zip(*columns):
            if held is not None and (key != held or len(ids) == IDS):
                out.append(piece())
                ids = []
            held = key
            ids.append(conv)
        if out:
            yield _batch(out, [pa.int64()] * 6 + [pa.string()], ["m", *KEY, "first", "piece"])
    if held is not None:
        yield _batch([piece()], [pa.int64()] * 6 + [pa.string()], ["m", *KEY, "first", "piece"])


def _hash_pieces(batches):
    """One hash per key from its pieces in order; memory holds one state, not the list."""
    held, state = None, None
    kinds, names = [pa.int64()] * 5 + [pa.string()], ["m", *KEY, "ends_sha256"]
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for m, k1, k2, k3, k4, _, piece in zip(*columns):
            key = [m, k1, k2, k3, k4]
            if key != held:
                if held is not None:
                    out.append([*held, state.hexdigest()])
                held, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if out:
            yield _batch(out, kinds, names)
    if held is not None:
        yield _batch([[*held, state.hexdigest()]], kinds, names)


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def end_lists(convs: DataFrame) -> DataFrame:
    """``m, k1..k4, ends_sha256``: hash of the sorted ids of the conversations that are this sequence.

    Ids are range-partitioned with the key, so a sequence that very many
    conversations share is written as pieces by many tasks; a hash is a chain, so
    its pieces then pass one task, as a stream.
    """
    key = ["m", *KEY]
    schema = ", ".join(f"{c} bigint" for c in [*key, "first"]) + ", piece string"
    pieces = (convs.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
              .mapInArrow(_id_pieces, schema))
    return (pieces.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(_hash_pieces, ", ".join(f"{c} bigint" for c in key) + ", ends_sha256 string"))


def rebuilt(df: DataFrame, scratch: Scratch, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv, chunk, pos, h1, h2, chars`` of the rebuilt conversations, and ``conv, last_chunk`` of all."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    plain = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"),
        digest(role_, text_).alias("h"), F.length(text_).cast("bigint").alias("chars"))
    turns = scratch.keep(
        with_position(plain.select("conv", "turn", "role", "h.h1", "h.h2", "chars"),
                      ["conv"], ["turn", "role", "h1", "h2"], "i")
        .select("conv", "i", F.floor(F.col("i") / CHUNK).cast("bigint").alias("chunk"), "h1", "h2", "chars"), "turns")
    own = turns.groupBy("conv").agg(F.max("chunk").alias("last_chunk")).withColumn("h", _shared(F.col("conv")))
    openings = (turns.where(f"conv % 100 = 0 and i < {OPENING}").groupBy("conv")
                .agg(F.array_sort(F.collect_list(F.struct("i", "h1", "h2", "chars"))).alias("opening"))
                .withColumnRenamed("conv", "donor"))
    empty = F.array().cast("array<struct<i:bigint,h1:bigint,h2:bigint,chars:bigint>>")
    convs = scratch.keep(
        own.withColumn("donor", F.col("conv") - F.col("conv") % 100).join(openings, "donor", "left")
        .select("conv", "last_chunk", "h", F.coalesce(F.slice("opening", F.lit(1), F.col("h").cast("int")), empty)
                .alias("opening")), "conversations")
    first = convs.select("conv", F.lit(0).cast("bigint").alias("chunk"), F.inline("opening")).select(
        "conv", "chunk", F.col("i").alias("pos"), "h1", "h2", "chars")
    shift = _per_chunk(convs.select("conv", "last_chunk", (F.size("opening") - F.col("h")).alias("shift")), "last_chunk")
    rest = (turns.where(F.col("i") >= _shared(F.col("conv"))).join(shift, ["conv", "chunk"])
            .select("conv", "chunk", (F.col("i") + F.col("shift")).alias("pos"), "h1", "h2", "chars"))
    return first.unionAll(rest), convs.select("conv", "last_chunk")


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """One row per node of the prefix trie of all rebuilt conversations.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Turns are ordered by turn (null first), equal turns by role and then by a hash of role and text;
    repeated rows are repeated turns.  Null roles and texts are empty, texts count whole.  Rows without
    a conversation id belong to none and are left out; an empty table has no node, not even a root.
    Columns other than the four named are not read, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "trie")
    key = ["m", *KEY]
    turns, ids = rebuilt(df, scratch, conv_col, turn_col, role_col, text_col)
    keyed = scratch.keep(turns.select("conv", "chunk", "pos", "chars", *_lanes(F.col("pos"))), "keyed")

    # identical conversations become one weighted sequence; turnless ones are the root's
    zeros = ids.select("conv", F.lit(0).cast("bigint").alias("n"), *[F.lit(0).cast("bigint").alias(k) for k in KEY])
    convs = scratch.keep(
        keyed.select("conv", F.lit(1).cast("bigint").alias("n"), *KEY).unionAll(zeros).groupBy("conv")
        .agg(F.sum("n").alias("m"), *[F.sum(k).alias(k) for k in KEY]).join(ids, "conv"), "convs")
    sequences = scratch.keep(
        convs.groupBy(*key).agg(F.count("*").alias("w"), F.min(F.struct("conv", "last_chunk")).alias("r"))
        .select(*key, "w", "r.conv", "r.last_chunk"), "sequences")
    unfolded = keyed.join(_per_chunk(sequences.select("conv", "last_chunk", "w", "m"), "last_chunk"), ["conv", "chunk"])
    own = [F.col(k).alias(f"own_{k}") for k in KEY]
    prefixes = scratch.keep(
        _running(unfolded.select("conv", "chunk", "w", "m", "chars", (F.col("pos") + 1).alias("depth"), *KEY, *own),
                 "depth", {k: f"own_{k}" for k in KEY})
        .select("conv", "chunk", "depth", "w", "m", "chars", *KEY,
                *[(F.col(k) - F.col(f"own_{k}")).alias(f"p{k}") for k in KEY]), "prefixes")
    scratch.drop("turns", "conversations", "keyed")

    nodes = scratch.keep(
        prefixes.groupBy("depth", *KEY).agg(
            F.sum("w").alias("n_convs"), F.min("conv").alias("conv"), F.max(F.col("m") > F.col("depth")).alias("inner"),
            *[F.min(f"p{k}").alias(f"p{k}") for k in KEY]), "nodes")

    # leaves: sequences that are no proper prefix of another one
    deeper = nodes.where("inner").select(F.col("depth").alias("m"), *KEY)
    leaves = (sequences.where("m > 0").join(deeper, key, "left_anti")
              .select("conv", "last_chunk", F.lit(1).cast("bigint").alias("leaf")))

    # each node's gain lies on the path of its smallest member; what lies below a prefix is a sum from its depth on
    gains = nodes.select("conv", "depth", F.lit(1).alias("owned"), F.col("n_convs").alias("through"))
    paths = (prefixes.join(gains, ["conv", "depth"], "left")
             .withColumn("gain", F.when(F.col("owned") == 1, (F.col("through") - 1) * F.col("chars")).otherwise(F.lit(0)))
             .select("conv", "chunk", "depth", *KEY, "gain"))
    below = _running(paths, "depth", {"saved": "gain"}, backwards=True).join(
        _per_chunk(leaves, "last_chunk"), ["conv", "chunk"], "left")
    totals = below.groupBy("depth", *KEY).agg(
        F.sum("saved").alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(k) for k in KEY]).agg(
        F.count("*").alias("n_children"))
    ends = scratch.keep(end_lists(convs), "ends")
    full = scratch.keep(
        nodes.drop("inner").join(totals, ["depth", *KEY]).join(children, ["depth", *KEY], "left")
        .join(ends.withColumnRenamed("m", "depth"), ["depth", *KEY], "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0)),
                      "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))}), "full")

    root = _root(convs, full, ends)
    above = full.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{k}") for k in KEY],
                        F.col("conv").alias("parent"))
    smallest = root.select(F.lit(1).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(f"p{k}") for k in KEY],
                           F.col("conv").alias("parent"))
    placed = split_join(full, above.unionAll(smallest), ["depth", *[f"p{k}" for k in KEY]],
                        F.struct(*KEY), "inner")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = scratch.keep(
        placed.select("conv", "depth", "parent", *figures)
        .unionAll(root.select("conv", F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), *figures))
        .toDF(conv_col, "depth", f"parent_{conv_col}", *figures), "result")
    scratch.drop("convs", "sequences", "prefixes", "nodes", "ends", "full")
    return out


def _root(convs: DataFrame, full: DataFrame, ends: DataFrame) -> DataFrame:
    """The textless node above all others, as one row (none for an empty table)."""
    zero = lambda name: F.lit(0).cast("bigint").alias(name)
    # a node's own gain is what its subtree saves less what its children's subtrees save: the first level has all
    parts = convs.select("conv", F.lit(1).cast("bigint").alias("n_convs"), zero("n_children"), zero("n_leaves"),
                         zero("saved_tokens"), F.lit(None).cast("string").alias("ends_sha256"))
    parts = parts.unionAll(full.where("depth = 1").select(
        F.lit(None).cast("bigint"), zero("a"), F.lit(1).cast("bigint"), "n_leaves", "saved_tokens",
        F.lit(None).cast("string")))
    parts = parts.unionAll(ends.where("m = 0").select(
        F.lit(None).cast("bigint"), zero("a"), zero("b"), zero("c"), zero("d"), "ends_sha256"))
    return (parts.agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in
                                                      ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                      F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(""), 256)).alias("ends_sha256"))
            .where("n_convs > 0").withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("bigint"))))
