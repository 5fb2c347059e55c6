"""Exact k-means on integer vectors with heap-ordered bounds.

Vectors lie in blocks of some thousand rows.  The blocks are written once; beside
them goes a small state: the cluster of every vector and, per cluster, a heap of
gaps.  The gap of a vector is the distance to its second nearest centroid less
the distance to its own.  A round lowers it by at most what its own centroid
moved plus the largest move of another one.  That drift is the same for all
vectors of a cluster, so it is added up once per cluster and a gap is pushed as
``gap + drift so far``: the heap keeps its order, and a round pops just the
vectors whose key the drift has passed.  Only those are compared with all
centroids again, in exact integers; a vector left in its heap cannot have changed.

Blocks and state are bucketed by block and join without a shuffle.  A task hands
on one row of changed sums; the driver sees ``k * (dimension + 2)`` numbers a round.
"""

import hashlib
import heapq
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

BLOCK = 4096
# components beyond it could bring a squared distance of 64 components past a long
LARGEST = 2 ** 27
# up to here every sum in a product of 64 components is exact in double precision
EXACT_DOUBLE = 2 ** 22

_BLOCKS = "block bigint, ids array<bigint>, points binary"
_STATE = ("block bigint, cluster binary, keys binary, rows binary, sizes array<int>, "
          "changes array<decimal(38,0)>")


def _usable(vector: str, dimension: int):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & ~bad


def _to_blocks(dimension: int, scale: int):
    def fold(batches):
        from pyspark import TaskContext
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                block += 1
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                points = np.floor(x * float(scale))
                if len(points) and np.abs(points).max() > LARGEST:
                    raise ValueError(f"components over {LARGEST / scale:g} make distances that no long holds")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([points.astype(np.int32).tobytes()], pa.binary())],
                    names=["block", "ids", "points"])
    return fold


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as 64-bit integers."""
    most = max(int(np.abs(a).max(initial=0)) for a in (points, centres))
    if most <= EXACT_DOUBLE and points.shape[1] <= 64:
        x, c = points.astype(np.float64), centres.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
        return d.astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(1) for c in centres.astype(np.int64)], 1)


class _Heaps:
    """One heap of (key, row) per cluster, kept between rounds as flat arrays in heap order."""

    def __init__(self, k: int, keys: bytes = b"", rows: bytes = b"", sizes=None):
        self.heaps, at = [], 0
        keys, rows = np.frombuffer(keys), np.frombuffer(rows, np.int32)
        for size in (sizes or [0] * k):
            self.heaps.append(list(zip(keys[at:at + size].tolist(), rows[at:at + size].tolist())))
            at += size

    def expired(self, drift: list[float]) -> list[int]:
        """Rows whose gap may be used up; ties and rounding count as used up."""
        out = []
        for heap, moved in zip(self.heaps, drift):
            limit = moved + 1e-9 * (1.0 + abs(moved))
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return sorted(out)

    def push(self, cluster: int, key: float, row: int) -> None:
        heapq.heappush(self.heaps[cluster], (key, row))

    def flat(self) -> tuple[bytes, bytes, list[int]]:
        pairs = [p for heap in self.heaps for p in heap]
        return (np.array([p[0] for p in pairs], np.float64).tobytes(),
                np.array([p[1] for p in pairs], np.int32).tobytes(), [len(h) for h in self.heaps])


def _gaps(distances: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Lower bound of what lies between the nearest and the second nearest centroid."""
    if distances.shape[1] == 1:
        return np.full(len(distances), math.inf)
    at = np.arange(len(distances))
    own = np.sqrt(distances[at, nearest].astype(np.float64))
    rest = distances.astype(np.float64)
    rest[at, nearest] = np.inf
    other = np.sqrt(rest.min(1))
    return (other - own) - 1e-9 * (other + own + 1)


def _visit(centres: np.ndarray, drift: list[float], dimension: int):
    """A round over blocks joined with their state (or over new blocks)."""
    k = len(centres)

    def one(row: dict, n: np.ndarray, sums: np.ndarray, squares: list[int]) -> list:
        points = np.frombuffer(row["points"], np.int32).reshape(-1, dimension)
        if row.get("cluster") is None:
            cluster, heaps, todo = np.full(len(points), -1, np.int32), _Heaps(k), list(range(len(points)))
        else:
            cluster = np.frombuffer(row["cluster"], np.int32).copy()
            heaps = _Heaps(k, row["keys"], row["rows"], row["sizes"])
            todo = heaps.expired(drift)
        if todo:
            moved = points[todo]
            distances = squared_distances(moved, centres)
            nearest = distances.argmin(1)
            for r, c, key in zip(todo, nearest.tolist(), _gaps(distances, nearest).tolist()):
                heaps.push(c, key + drift[c], r)
            before = cluster[todo]
            wide = moved.astype(np.int64)
            length = (wide * wide).sum(1)
            for sign, of, which in ((1, nearest, nearest != before), (-1, before, (nearest != before) & (before >= 0))):
                for c in np.unique(of[which]).tolist():
                    inside = which & (of == c)
                    n[c] += sign * int(inside.sum())
                    sums[c] += sign * wide[inside].sum(0)
                    squares[c] += sign * sum(length[inside].tolist())
            cluster[todo] = nearest
        return [row["block"], cluster.tobytes(), *heaps.flat()]

    def rows(batches):
        n, sums, squares = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64), [0] * k
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                if held is not None:
                    yield [*held, None]
                held = one({f: batch.column(i)[at].as_py() for i, f in enumerate(batch.schema.names)}, n, sums, squares)
        if held is not None:  # the last block of a task carries the task's sums
            yield [*held, [Decimal(v) for v in n.tolist() + sums.ravel().tolist() + squares]]

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.decimal128(38, 0))]
    names = [part.split()[0] for part in _STATE.split(", ")]

    def visit(batches):
        for row in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
    return visit


def _measure(centres: np.ndarray, dimension: int):
    def fold(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, points, cluster = (batch.column(i)[at].as_py() for i in range(3))
                points = np.frombuffer(points, np.int32).reshape(-1, dimension)
                cluster = np.frombuffer(cluster, np.int32)
                distance = np.empty(len(points), np.int64)
                for c in np.unique(cluster).tolist():
                    inside = cluster == c
                    distance[inside] = squared_distances(points[inside], centres[c:c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)],
                    names=["id", "cluster", "distance"])
    return fold


def _changes(state: DataFrame) -> list[int]:
    """The changes of counts, sums and squares over all tasks, entry by entry."""
    rows = (state.where("changes is not null").select(F.posexplode("changes")).groupBy("pos")
            .agg(F.sum("col").alias("s")).orderBy("pos").collect())
    return [int(r["s"]) for r in rows]


def _drifts(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """Per cluster: its own move plus the largest move of another centroid, rounded up."""
    moves = [math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) * (1 + 1e-12) for p, q in zip(old, new)]
    return [m + max((x for j, x in enumerate(moves) if j != i), default=0.0) for i, m in enumerate(moves)]


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8,
                      rounds: int = 10, dimension: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Cluster of every usable vector after ``rounds`` exact rounds and a last assignment.

    Returns ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row per row of
    ``df`` with exactly ``dimension`` components, none null or non-finite; other rows are not clustered.
    Component ``x`` becomes the integer ``floor(scale * x)``.  The first centroids are the ``k`` vectors
    with the smallest hash of ``seed:id`` (fewer vectors: fewer centroids); a null id hashes as empty text
    and is clustered like any other, equal hashes are ordered by their components.  Repeated rows count
    as often as they occur, ties go to the smaller cluster number, an empty table gives no rows, an empty
    cluster keeps its centroid.  Components beyond 2^27 / ``scale`` end the job with an error.  Columns
    other than the two named are not read.
    """
    spark: SparkSession = df.sparkSession
    named = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = named.where(_usable("v", dimension))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(order, "v").limit(k).collect()
    if not first:
        return _result(spark.createDataFrame([], "id bigint, cluster int, distance bigint"), id_col, [0], [""])
    centres = [[math.floor(scale * x) for x in r["v"]] for r in first]
    k = len(centres)

    scratch = Scratch(spark, "centroids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.keep_bucketed(kept.mapInArrow(_to_blocks(dimension, scale), _BLOCKS), "blocks", "block", buckets)
    totals = [0] * (k * (dimension + 2))
    drift, state = [0.0] * k, None
    for turn in range(rounds + 1):
        source = blocks.drop("ids") if state is None else blocks.drop("ids").join(
            state.select("block", "cluster", "keys", "rows", "sizes"), "block")
        visit = _visit(np.array(centres, np.int64), drift, dimension)
        state = scratch.keep_bucketed(source.mapInArrow(visit, _STATE), f"state-{turn}", "block", buckets)
        if turn:
            scratch.drop(f"state-{turn - 1}")
        totals = [a + b for a, b in zip(totals, _changes(state))]
        counts, flat, squares = totals[:k], totals[k:-k], totals[-k:]
        sums = [flat[c * dimension:(c + 1) * dimension] for c in range(k)]
        if turn < rounds:
            new = [[s // counts[c] for s in sums[c]] if counts[c] else centres[c] for c in range(k)]
            drift = [a + b for a, b in zip(drift, _drifts(centres, new))]
            centres = new
    inertia = [squares[c] - 2 * sum(a * b for a, b in zip(centres[c], sums[c]))
               + counts[c] * sum(a * a for a in centres[c]) for c in range(k)]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    out = (blocks.join(state.select("block", "cluster"), "block").select("ids", "points", "cluster")
           .mapInArrow(_measure(np.array(centres, np.int64), dimension), "id bigint, cluster int, distance bigint"))
    return _result(out, id_col, inertia, hashes)


def _result(rows: DataFrame, id_col: str, inertia: list[int], hashes: list[str]) -> DataFrame:
    at = F.col("cluster") + 1
    return rows.select(
        F.col("id").alias(id_col), "cluster", "distance",
        F.element_at(F.array(*[F.lit(i).cast("bigint") for i in inertia]), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"),
        F.element_at(F.array(*[F.lit(h) for h in hashes]), at).alias("centroid_sha256"))
