"""Pairwise sums of many numeric columns in one pass."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double

BLOCK = 64          # columns of a block
FOLDS = 64          # first-level sums of a block

_SCHEMA = "task int, i0 int, j0 int, cells array<double>"


def _blocks_of(task: int, parts: np.ndarray) -> pa.RecordBatch:
    """The blocks on and above the diagonal of (k, p, p) matrices, each flattened to one array."""
    starts = range(0, parts.shape[1], BLOCK)
    keys = [(i, j) for i in starts for j in starts if i <= j]
    cells = [parts[:, i:i + BLOCK, j:j + BLOCK].ravel() for i, j in keys]
    return _batch([task] * len(keys), keys, cells)


def _batch(tasks, keys, cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(tasks, pa.int32()), pa.array([k[0] for k in keys], pa.int32()),
         pa.array([k[1] for k in keys], pa.int32()), pa.array(cells, pa.list_(pa.float64()))],
        names=["task", "i0", "j0", "cells"])


def _added(batches):
    """Sums of the arrays of each block in a partition; holds one array a block."""
    sums, task = {}, 0
    for batch in batches:
        task = batch.column(0)[0].as_py() if batch.num_rows else task
        keys = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for row, key in enumerate(keys):
            cells = batch.column(3)[row].values.to_numpy()
            sums[key] = sums[key] + cells if key in sums else cells
    if sums:
        yield _batch([task] * len(sums), list(sums), list(sums.values()))


def block_sums(staged: DataFrame, fold, p: int, names: list[str]) -> DataFrame:
    """``(i, j, *names)`` for columns i <= j: matrices that ``fold`` makes of a task's Arrow batches, summed.

    ``fold`` returns an array of shape (len(names), p, p).  A task hands on one
    array per pair of column blocks; these are summed in ``FOLDS`` parts, so no
    task adds up the arrays of all others.  Only then cells become rows, at most
    ``FOLDS`` for each pair of columns however many tasks there were.
    """
    def run(batches):
        yield _blocks_of(TaskContext.get().partitionId(), fold(batches))

    parts = staged.mapInArrow(run, _SCHEMA)
    first = parts.repartition("i0", "j0", F.pmod("task", F.lit(FOLDS))).mapInArrow(_added, _SCHEMA)
    width = F.least(F.lit(BLOCK), F.lit(p) - F.col("j0"))
    height = F.least(F.lit(BLOCK), F.lit(p) - F.col("i0"))
    cell = F.posexplode(F.slice("cells", F.lit(1), width * height)).alias("at", "cell")
    return (first.select("i0", "j0", "cells", width.alias("w"), (width * height).alias("size"), cell)
            .select((F.col("i0") + F.floor(F.col("at") / F.col("w"))).cast("int").alias("i"),
                    (F.col("j0") + F.col("at") % F.col("w")).cast("int").alias("j"),
                    *[F.get("cells", F.col("at") + k * F.col("size")).alias(c) for k, c in enumerate(names)])
            .filter("i <= j").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]))


def pair_sums(df: DataFrame, names: list[str], centre: dict[str, float | None]) -> DataFrame:
    """Sums over the rows where both columns are present, for every pair i <= j.

    Values are shifted by ``centre`` (the column means) against cancellation.
    Each task folds its Arrow batches into p x p matrices and emits them once, as
    a few arrays, whatever the number of rows.
    """
    shift = np.array([centre.get(c) or 0.0 for c in names])
    p = len(names)

    def fold(batches):
        parts = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(p)])
            x = x.astype(float) - shift
            present = ~np.isnan(x)
            m = present.astype(float)
            x = np.where(present, x, 0.0)
            xm, xxm = x.T @ m, (x * x).T @ m
            parts += np.stack([m.T @ m, xm, xm.T, xxm, xxm.T, x.T @ x])
        return parts

    staged = df.select(*[as_double(c).alias(f"x{k}") for k, c in enumerate(names)])
    return block_sums(staged, fold, p, ["n", "sx", "sy", "sxx", "syy", "sxy"])


def pearson_pairs(df: DataFrame, names: list[str], centre: dict[str, float | None]) -> DataFrame:
    """``(i, j, col_a, col_b, value)`` for i < j: correlation over pairwise-complete rows.

    ``value`` is NULL where either column is constant on the shared rows.
    """
    label = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # what rounding leaves where the true variance is zero: a tiny part of the sum of squares,
    # or deviations from the mean of a few units in the last place
    last_place = F.array(*[F.lit((8 * 2.2e-16 * (centre.get(c) or 0.0)) ** 2) for c in names])
    noise = lambda c, sq: F.greatest(F.col(sq) * 1e-12,
                                     F.col("n") * F.element_at(last_place, F.col(c) + 1))
    flat = (vx <= noise("i", "sxx")) | (vy <= noise("j", "syy"))
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    value = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return (pair_sums(df, names, centre).filter((F.col("i") < F.col("j")) & (F.col("n") > 0))
            .select("i", "j", label("i").alias("col_a"), label("j").alias("col_b"),
                    value.alias("value")))
