"""Near-duplicate vectors by a robust-pruned graph.

Vectors of one label are dealt to overlapping cluster shards of bounded size.
Each shard builds a pruned neighbour graph; the adjacency lists of a vector from
all its shards are united.  Every vector then searches: greedily from the medoid
of its shard and its own place, and from there over everything in range.  Links that leave the
shards follow united edges across them until nothing new is found.  All links
are confirmed by cosine in double precision.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, stored

COSINE = 0.98
SHARD_ROWS = 3000       # most vectors of a shard
SAMPLE = 2048           # vectors that fit the centres of one split, chosen by hash
FANOUT = 64             # most clusters of one split
DEGREE, POOL, ALPHA, BEAM = 24, 64, 1.2, 32
FAR, FAR_POOL = 8, 32   # edges of DEGREE kept for rows outside the pool; candidates for them, at ranks of equal ratio
ROWS_AT_ONCE = 256      # rows that are pruned or searched for together
PRUNED_CELLS, EXPANDED = 1 << 20, 1 << 14      # numbers, and vectors with their neighbours, held at a time by one step of those
KEPT_BACK = 6           # edges back to a vector that pruning never removes
AUDIT = 256             # vectors held against all others
LEAST_RECALL = 0.9

NODE = "path string, id long, unit array<double>"


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def prune(ids: np.ndarray, near: np.ndarray, unit: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Robust pruning: the nearest first, dropping those much nearer to one already kept."""
    order = ids[np.argsort(-near, kind="stable")]
    near = np.sort(-near, kind="stable")
    gap = np.sqrt(np.maximum(0.0, 2 + 2 * near))    # distance of unit vectors, near is negated
    alive = np.ones(len(order), bool)
    kept = []
    for i in range(len(order)):
        if not alive[i]:
            continue
        kept.append(int(order[i]))
        if len(kept) == degree:
            break
        rest = np.flatnonzero(alive[i + 1:]) + i + 1
        between = np.sqrt(np.maximum(0.0, 2 - 2 * (unit[order[rest]] @ unit[order[i]])))
        alive[rest[alpha * between <= gap[rest]]] = False
    return kept


def prune_many(ids: np.ndarray, near: np.ndarray, unit: np.ndarray, degree: int, alpha: float) -> list[list[int]]:
    """``prune`` of many rows at once: (rows, candidates) ids, -1 where a row has fewer, and their cosines."""
    if not ids.size:
        return [[] for _ in ids]
    most = max(1, PRUNED_CELLS // (ids.shape[1] * max(ids.shape[1], unit.shape[1])))
    if len(ids) > most:
        return [kept for at in range(0, len(ids), most) for kept in prune_many(ids[at:at + most], near[at:at + most], unit, degree, alpha)]
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * near))
    part = unit[ids]
    drops = alpha * np.sqrt(np.maximum(0.0, 2 - 2 * (part @ part.transpose(0, 2, 1)))) <= gap[:, None, :]
    alive, kept, n_kept = ids >= 0, np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for i in range(ids.shape[1]):
        kept[:, i] = alive[:, i] & (n_kept < degree)
        n_kept += kept[:, i]
        alive &= ~(drops[:, i] & kept[:, i, None])
    return [row[at].tolist() for row, at in zip(ids, kept, strict=True)]


def build(unit: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> list[list[int]]:
    """Pruned neighbours of every row, with edges back, pruned again where there are too many.

    Rows outside the pool are candidates too, at ranks that grow by a ratio up to
    the last row, with edges of their own: a group of more near copies than the
    pool holds keeps edges out of the group.
    """
    n = len(unit)
    out: list[list[int]] = []
    beyond: list[list[int]] = []
    far = min(FAR, degree // 2) if n - 1 > pool else 0
    for start in range(0, n, ROWS_AT_ONCE):
        near = unit[start:start + ROWS_AT_ONCE] @ unit.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -2
        size = min(pool, n - 1)
        ranks = np.unique(np.geomspace(pool, n - 2, FAR_POOL).astype(int)) if far else np.empty(0, int)
        # the nearest are in front, and the row of each rank at its place
        placed = np.argpartition(-near, np.union1d(ranks, [size - 1]), axis=1) if size else np.empty((len(near), 0), int)
        best, wide = placed[:, :size], placed[:, ranks]
        out += prune_many(best, np.take_along_axis(near, best, 1), unit, degree - far, alpha)
        beyond += prune_many(wide, np.take_along_axis(near, wide, 1), unit, far, alpha) if far else [[] for _ in near]
    back: list[set[int]] = [set(x) for x in out]
    for i, xs in enumerate(out):
        for x in xs:
            back[x].add(i)
    lists = [sorted(xs) for xs in back]
    # those with too many, of like length together; one with very many by itself
    many = sorted((i for i, xs in enumerate(lists) if degree - far < len(xs) <= 2 * pool), key=lambda i: len(lists[i]))
    for at in range(0, len(many), ROWS_AT_ONCE // 2):
        rows = many[at:at + ROWS_AT_ONCE // 2]
        ids = np.full((len(rows), max(len(lists[i]) for i in rows)), -1)
        for row, i in enumerate(rows):
            ids[row, :len(lists[i])] = lists[i]
        near = np.where(ids >= 0, np.einsum("ij,ikj->ik", unit[rows], unit[ids]), -2)
        for i, kept in zip(rows, prune_many(ids, near, unit, degree - far, alpha), strict=True):
            lists[i] = kept
    result = []
    for i, xs in enumerate(lists):
        if len(xs) > 2 * pool:
            ids = np.array(xs, int)
            xs = prune(ids, unit[ids] @ unit[i], unit, degree - far, alpha)
        result.append(xs + [x for x in beyond[i] if x not in xs])
    for i, xs in enumerate(out):    # every vector stays reachable from those nearest to it
        for x in xs[:KEPT_BACK]:
            if i not in result[x]:
                result[x].append(i)
    return result


def search(q: np.ndarray, unit: np.ndarray, edges: np.ndarray, entries: list[int], cosine: float,
           beam: int = BEAM) -> np.ndarray:
    """Rows within range of ``q``, as ``search_many`` finds them."""
    return search_many(q[None], unit, edges, np.array([entries]), cosine, beam)[1]


def search_many(q: np.ndarray, unit: np.ndarray, edges: np.ndarray, entries: np.ndarray, cosine: float,
                beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows within range: greedy descent from the entries of each query, then all that range edges reach.

    ``edges`` is a table of neighbours padded with -1.  The expansion also steps
    over vectors up to twice the angle away, between which members may lie.
    All queries take a step at the same time; what one has seen is a row of flags.
    """
    slack = math.cos(min(math.pi, 2 * math.acos(min(1.0, cosine))))
    n, m = len(unit), len(q)
    near = (q @ unit.T).ravel()
    seen, found = np.zeros(m * n, bool), np.zeros(m * n, bool)

    # the beam of a query: places in order of nearness, -1 where there are fewer, and whether they were expanded
    ids = np.full((m, beam), -1)
    done = np.ones((m, beam), bool)
    entry = np.sort(entries, axis=1) + np.arange(m)[:, None] * n
    new = np.unique(entry)
    seen[new] = True
    while len(new):
        found[new[near[new] >= cosine]] = True       # also those that the beam has no place for
        # old and new places of the queries that got some, nearest first
        of = np.unique(new // n)
        count = np.bincount(np.searchsorted(of, new // n), minlength=len(of))
        wide = np.full((len(of), beam + count.max()), -1)
        wide[:, :beam] = ids[of]
        first = np.repeat(np.cumsum(count) - count, count)
        wide[np.repeat(np.arange(len(of)), count), beam + np.arange(len(new)) - first] = new
        was = np.zeros(wide.shape, bool)
        was[:, :beam] = done[of]
        key = np.where(wide >= 0, -near[wide], np.inf)
        top = np.argsort(key, axis=1, kind="stable")[:, :beam]
        ids[of] = np.take_along_axis(wide, top, 1)
        done[of] = np.take_along_axis(was, top, 1) | (ids[of] < 0)
        step = ~done & (np.cumsum(~done, axis=1) <= 4)
        done |= step
        some = ids[step]
        to = edges[some % n]
        new = ((some - some % n)[:, None] + to)[to >= 0]
        new = np.unique(new[~seen[new]])
        seen[new] = True
    reached = np.zeros(m * n, bool)
    places = ids[ids >= 0]
    reached[places] = True
    front = places[near[places] >= slack]
    mark = np.empty(m * n, np.int32)
    while len(front):
        ahead = []
        for at in range(0, len(front), EXPANDED):
            some = front[at:at + EXPANDED]
            to = edges[some % n]
            new = ((some - some % n)[:, None] + to)[to >= 0]
            new = new[~reached[new]]
            mark[new] = np.arange(len(new))
            new = new[mark[new] == np.arange(len(new))]      # each once
            reached[new] = True
            found[new[near[new] >= cosine]] = True
            ahead.append(new[near[new] >= slack])
        front = np.concatenate(ahead)
    hits = np.flatnonzero(found)
    return hits // n, hits % n


def _centres(sample: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means on the sample of one path; as many centres as its rows need."""
    unit = _matrix(sample.sort_values("id")["unit"])
    # every vector goes to two clusters, which should be well under the limit
    k = int(min(FANOUT, len(unit), max(3, math.ceil(3 * sample["rows"].iloc[0] / sample["most"].iloc[0]))))
    rng = np.random.default_rng(0)
    centre = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(10):
        own = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(length > 0, total / np.where(length > 0, length, 1), centre)
    return pd.DataFrame({"path": sample["path"].iloc[0], "centres": [centre.ravel().tolist()], "k": k})


def _deal(batches):
    """Every vector to its two nearest clusters."""
    for batch in batches:
        frame = batch.to_pandas()
        out = []
        for path, rows in frame.groupby("path", sort=False):
            unit = _matrix(rows["unit"])
            centre = np.asarray(rows["centres"].iloc[0]).reshape(int(rows["k"].iloc[0]), -1)
            nearest = np.argsort(-(unit @ centre.T), axis=1, kind="stable")[:, :2]
            for at in range(nearest.shape[1]):
                out.append(pd.DataFrame({"path": [f"{path}/{c}" for c in nearest[:, at]], "id": rows["id"].to_numpy(),
                                         "unit": rows["unit"].to_numpy()}))
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False, schema=pa.schema(
                [("path", pa.string()), ("id", pa.int64()), ("unit", pa.list_(pa.float64()))]))


def shards(nodes: DataFrame, most: int = SHARD_ROWS) -> DataFrame:
    """Rows of ``nodes`` with the paths of their shards; paths over ``most`` rows are split, level by level."""
    done, rest = None, nodes
    while True:
        sizes = stored(rest.groupBy("path").agg(F.count("*").alias("rows")), "sizes")
        large = sizes.where(F.col("rows") > most)
        small = rest.join(large, "path", "left_anti")
        done = small if done is None else done.unionAll(small)
        if large.isEmpty():
            return stored(done.dropDuplicates(["path", "id"]), "shards")
        rest = rest.join(large, "path")
        share = F.lit(SAMPLE * 2.0 ** 32) / F.col("rows")
        sample = rest.withColumn("most", F.lit(most)).where(F.pmod(F.xxhash64("id", "path"), F.lit(2 ** 32)) < share)
        centres = sample.groupBy("path").applyInPandas(_centres, "path string, centres array<double>, k int")
        rest = stored(rest.join(stored(centres, "centres"), "path").select("path", "id", "unit", "centres", "k")
                      .mapInArrow(_deal, NODE), "split")


def _edges(members: pd.DataFrame) -> pd.DataFrame:
    members = members.sort_values("id")
    ids, unit = members["id"].to_numpy(), _matrix(members["unit"])
    lists = build(unit)
    return pd.DataFrame({"id": ids, "near": [ids[x].tolist() for x in lists],
                         "cos": [(unit[x] @ unit[i]).tolist() for i, x in enumerate(lists)]})


def _searches(cosine: float):
    def run(members: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("id")
        ids, unit = members["id"].to_numpy(), _matrix(members["unit"])
        place = pd.Index(ids)
        edges = np.full((len(ids), max([1, *map(len, lists["near"])])), -1)
        for row, near in zip(place.get_indexer(lists["node"]), lists["near"], strict=True):
            to = place.get_indexer(np.asarray(near))    # -1 outside this shard
            edges[row, :len(to)] = to
        mean = unit.sum(axis=0)
        medoid = int(np.argmax(unit @ mean))
        a, b = [], []
        for at in range(0, len(ids), ROWS_AT_ONCE):
            own = np.arange(at, min(at + ROWS_AT_ONCE, len(ids)))     # a vector of the index is an entry itself
            query, hits = search_many(unit[own], unit, edges, np.stack([np.full(len(own), medoid), own], 1), cosine)
            a.append(ids[own[query]])
            b.append(ids[hits])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})
    return run


def links(nodes: DataFrame, cosine: float = COSINE, most: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)`` with a < b: linked nodes of one path of ``nodes``."""
    def pairs(df):
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    dealt = shards(nodes, most)
    own = stored(dealt.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths")), "paths")
    lists = stored(dealt.groupBy("path").applyInPandas(_edges, "id long, near array<long>, cos array<double>"), "lists")
    united = stored(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    local = dealt.select(F.col("path").alias("shard"), "id").join(united, "id").select("shard", F.col("id").alias("node"), "near")
    found = stored(pairs(dealt.groupBy("path").cogroup(local.groupBy("shard")).applyInPandas(
        _searches(cosine), "a long, b long")), "links")

    # edges between vectors that do not lie in the same shards, close enough to lead to a link
    slack = math.cos(2 * math.acos(cosine)) - 1e-9
    across = lists.select("id", F.explode(F.arrays_zip("near", "cos")).alias("e")).where(F.col("e.cos") >= slack) \
        .select("id", F.col("e.near").alias("other")).distinct() \
        .join(own, "id").join(own.select(F.col("id").alias("other"), F.col("paths").alias("other_paths")), "other") \
        .where("paths != other_paths").select("id", "other", "other_paths")
    across = stored(across, "across")
    unit = nodes.select("id", "unit")
    new, all_links = found, found
    while not across.isEmpty() and not new.isEmpty():
        both = new.unionAll(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        reach = both.join(across, both["b"] == across["id"]).where("a != other") \
            .join(own.select(F.col("id").alias("a"), "paths"), "a") \
            .where(~F.arrays_overlap("paths", "other_paths")).select("a", F.col("other").alias("b"))
        reach = pairs(reach).join(all_links, ["a", "b"], "left_anti")
        near = reach.join(unit.withColumnsRenamed({"id": "a", "unit": "u"}), "a") \
            .join(unit.withColumnsRenamed({"id": "b", "unit": "v"}), "b")
        dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        new = stored(near.where(dot >= cosine).select("a", "b"), "links")
        all_links = all_links.unionAll(new)
    return all_links


def audit(nodes: DataFrame, found: DataFrame, cosine: float = COSINE, size: int = AUDIT) -> float | None:
    """Share of a vector's links that were found, on average over ``size`` vectors chosen by hash that have links.

    The links are those that a comparison with every vector finds.  Each vector
    counts the same, so a large group of copies can't hide what others miss.
    """
    n = nodes.count()
    chosen = stored(nodes.where(F.pmod(F.xxhash64(F.col("id"), F.lit("audit")), F.lit(2 ** 32))
                                < F.lit(size * 2.0 ** 32 / max(n, 1))), "audit")
    rows = [(r["path"], r["id"], r["unit"]) for r in chosen.limit(4 * size).collect()]
    by_path: dict = {}
    for path, i, u in rows:
        by_path.setdefault(path, ([], []))[0].append(i)
        by_path[path][1].append(u)

    def against(batches):
        for batch in batches:
            frame = batch.to_pandas()
            a, b = [], []
            for path, part in frame.groupby("path"):
                if path in by_path:
                    ids, queries = by_path[path]
                    hit = np.argwhere(_matrix(part["unit"]) @ np.array(queries).T >= cosine)
                    a += [ids[j] for _, j in hit]      # the audited one
                    b += part["id"].to_numpy()[hit[:, 0]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    true = nodes.mapInArrow(against, "a long, b long").where("a != b").distinct()
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("hit", F.lit(1))
    return true.join(both, ["a", "b"], "left").groupBy("a").agg((F.count("hit") / F.count("*")).alias("share")) \
        .agg(F.avg("share")).first()[0]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, audited: bool = True, most: int = SHARD_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)`` for every row of ``(vec_id, embedding, label)``.

    Only vectors of one label and length are compared.  Equal vectors are one
    node of the graph and count as links of each other.  A vector that is null,
    empty or zero, or holds null or non-finite components, or has no label or id,
    links with nothing and is its own component.  Rows that repeat an id are
    vectors of their own with that id.  ``recall`` is that of the audit, null
    when the audit met no link; one under ``LEAST_RECALL`` is an error.
    """
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"),
                          F.col("label").alias("label"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (norm > 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = stored(rows.where("good").groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                     .withColumn("id", F.monotonically_increasing_id()), "classes")
    nodes = stored(classes.select(
        F.concat_ws(":", F.col("label").cast("string"), F.size("x")).alias("path"), "id",
        F.transform("x", lambda v: v / norm).alias("unit")), "nodes")
    found = links(nodes, cosine, most)
    recall = None
    if audited:
        recall = audit(nodes, found, cosine)
        if recall is not None and recall < LEAST_RECALL:
            raise RuntimeError(f"the graph finds {recall:.1%} of an audited vector's links; raise DEGREE or BEAM")
    copies = classes.select("id", "copies", "first")
    either = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = either.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
        F.sum("copies").alias("linked"))
    label = components(found)
    least = label.withColumnRenamed("node", "id").join(copies, "id").groupBy("component").agg(F.min("first").alias("least"))
    named = classes.join(degree, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left") \
        .join(least, "component", "left").select(
            "label", "x", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", "first").alias("component_id"))
    linked = rows.where("good").select("vec_id", "label", "x").join(named, ["label", "x"]).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))) \
        .withColumn("recall", F.lit(recall).cast("double"))
