"""Exact quantiles of table columns."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.session import cut_lineage

# Up to this many (rows x columns) one exact aggregate holds all values in
# bounded memory; beyond it the brackets below are used.
DIRECT_CELLS = 4_000_000
# A bracket with at most this many rows is finished by sorting its values.
FINISH_ROWS = 1_000_000
# Distinct values inside brackets that a task holds before it hands them on.
HELD_VALUES = 200_000

_SCHEMA = "k int, below bigint, upto bigint, under double, over double, v double, n bigint"


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
                    n_rows: int | None = None, direct_cells: int = DIRECT_CELLS,
                    accuracy: int = 10_000, finish_rows: int = FINISH_ROWS,
                    ) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles (as ``numpy.quantile``) of each named expression.

    Nulls are skipped.  The result has O(columns x probs) numbers, like
    ``DataFrame.approxQuantile``.  ``percentile`` keeps a map of all distinct
    values in one task, so above ``direct_cells`` the quantiles are bracketed
    instead: one mergeable sketch per column gives narrow value ranges, one pass
    counts the rows below and inside them exactly and groups the rows inside.  A
    range that missed its rank or is still too large goes through the same again.
    """
    if not columns:
        return {}
    if n_rows is None:
        n_rows = df.count()
    staged = df.select(*[c.cast("double").alias(f"q{i}") for i, c in enumerate(columns.values())])
    names = list(columns)
    per_job = max(1, direct_cells // max(1, n_rows))
    if n_rows * 1 <= direct_cells:
        out: dict[str, list[float | None]] = {}
        for at in range(0, len(names), per_job):
            part = range(at, min(at + per_job, len(names)))
            row = staged.agg(*[F.percentile(f"q{i}", F.lit(list(map(float, probs)))).alias(f"q{i}")
                               for i in part]).first()
            for i in part:
                out[names[i]] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
        return out
    return _bracketed(staged, names, probs, accuracy, finish_rows)


class _Bracket:
    """One sought order statistic and the value range known to hold it.

    ``below`` rows are smaller than ``lo`` and ``inside`` rows lie in ``lo`` to ``hi``.
    """

    def __init__(self, column: int, rank: int):
        self.column, self.rank = column, rank
        self.lo = self.hi = self.value = None
        self.below = self.inside = 0


def _bracketed(staged, names, probs, accuracy, finish_rows):
    margin = 2.0 / accuracy
    cuts = [p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    ends = staged.agg(*[f for i in range(len(names)) for f in (
        F.count(f"q{i}").alias(f"n{i}"), F.min(f"q{i}").alias(f"a{i}"), F.max(f"q{i}").alias(f"b{i}"),
        F.percentile_approx(f"q{i}", F.lit(cuts), F.lit(accuracy)).alias(f"c{i}"))]).first()
    sought: dict[tuple[int, int], _Bracket] = {}
    plans = []
    for i in range(len(names)):
        n = ends[f"n{i}"]
        for at, p in enumerate(probs if n else []):
            h = (n - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                if (i, rank) not in sought:
                    b = sought[i, rank] = _Bracket(i, rank)
                    b.lo, b.hi, b.inside = ends[f"a{i}"], ends[f"b{i}"], n
                    few = n * min(1.0, 2.5 * margin) <= finish_rows
                    plans.append((b, ends[f"c{i}"][2 * at], ends[f"c{i}"][2 * at + 1], few))
    while plans:
        _narrow(staged, plans, finish_rows)
        plans = _sketched(staged, [b for b in sought.values() if b.value is None], accuracy, finish_rows)
    out = {}
    for i, name in enumerate(names):
        n = ends[f"n{i}"]
        vals = []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            h = (n - 1) * p
            low, high = sought[i, math.floor(h)].value, sought[i, math.ceil(h)].value
            vals.append(low + (high - low) * (h - math.floor(h)))
        out[name] = vals
    return out


def _sketched(staged, todo, accuracy, finish_rows):
    """The next value range of each bracket (and whether its rows may be grouped): all of a small one, else by a sketch."""
    large = [b for b in todo if b.inside > finish_rows]
    plans = [(b, b.lo, b.hi, True) for b in todo if b.inside <= finish_rows]
    if not large:
        return plans
    margin = 2.0 / accuracy
    inside = lambda b: F.when(F.col(f"q{b.column}").between(b.lo, b.hi), F.col(f"q{b.column}"))
    cuts = staged.agg(*[
        F.percentile_approx(inside(b), F.lit([
            max(0.0, (b.rank - b.below) / b.inside - margin),
            min(1.0, (b.rank - b.below + 1) / b.inside + margin)]), F.lit(accuracy)).alias(f"c{k}")
        for k, b in enumerate(large)]).first()
    for k, b in enumerate(large):
        lo, hi = cuts[f"c{k}"]
        if lo == b.lo and (hi == b.hi or math.isnan(hi)):
            # the middle value splits a bracket whose ends the sketch could not move, or its least value when there is none
            mid = lo + (hi - lo) / 2
            hi = mid if math.isfinite(mid) else lo
        plans.append((b, lo, hi, False))
    return plans


def _narrow(staged, plans, finish_rows):
    """Count exactly where the ends of new ranges fall; find the values of those whose rows were grouped."""
    wanted: dict[int, list[tuple[int, float, float, bool]]] = {}
    for k, (b, lo, hi, group) in enumerate(plans):
        wanted.setdefault(b.column, []).append((k, lo, hi, group and lo != hi))
    columns = sorted(wanted)
    numbers = {c: np.array([k for k, *_ in wanted[c]]) for c in columns}
    lows = {c: np.array([lo for _, lo, _, _ in wanted[c]]) for c in columns}
    highs = {c: np.array([hi for _, _, hi, _ in wanted[c]]) for c in columns}
    grouped = {c: [j for j, w in enumerate(wanted[c]) if w[3]] for c in columns}

    def values(held):
        for k, parts in held.items():
            v, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield k, v, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def rows_of(held):
        for k, v, n in values(held):
            none = pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.float64()), pa.nulls(len(v), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), *none, pa.array(v), pa.array(n)],
                                             names=["k", "below", "upto", "under", "over", "v", "n"])

    def run(batches):
        below, upto = np.zeros(len(plans), np.int64), np.zeros(len(plans), np.int64)
        under, over = np.full(len(plans), -np.inf), np.full(len(plans), np.nan)
        held, size = {}, 0
        for batch in batches:
            for at, c in enumerate(columns):
                x = np.sort(batch.column(at).drop_null().to_numpy(zero_copy_only=False))  # NaN comes last, as in Spark
                if not len(x):
                    continue
                k, first, last = numbers[c], np.searchsorted(x, lows[c], "left"), np.searchsorted(x, highs[c], "right")
                below[k] += first
                upto[k] += last
                under[k] = np.where(first > 0, np.maximum(under[k], x[np.maximum(first - 1, 0)]), under[k])
                over[k] = np.where(last < len(x), np.fmin(over[k], x[np.minimum(last, len(x) - 1)]), over[k])
                for j in grouped[c]:
                    if last[j] > first[j]:
                        v, n = np.unique(x[first[j]:last[j]], return_counts=True)
                        held.setdefault(int(k[j]), []).append((v, n))
                        size += len(v)
            if size > HELD_VALUES:
                held = {k: [(v, n)] for k, v, n in values(held)}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD_VALUES / 2:
                    yield from rows_of(held)
                    held, size = {}, 0
        yield from rows_of(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(plans)), pa.int32()), pa.array(below), pa.array(upto), pa.array(under), pa.array(over),
             pa.nulls(len(plans), pa.float64()), pa.nulls(len(plans), pa.int64())],
            names=["k", "below", "upto", "under", "over", "v", "n"])

    found = cut_lineage(staged.select(*[f"q{c}" for c in columns]).mapInArrow(run, _SCHEMA))
    counts = {r["k"]: r for r in found.filter("n is null").groupBy("k").agg(
        F.sum("below").alias("below"), F.sum("upto").alias("upto"), F.max("under").alias("under"),
        F.min("over").alias("over")).collect()}
    ready = []
    for k, (b, lo, hi, group) in enumerate(plans):
        r, end = counts[k], b.below + b.inside
        if b.rank < r["below"]:                  # the sketch was off: keep the lower part
            b.hi, b.inside = r["under"], r["below"] - b.below
        elif b.rank >= r["upto"]:                # keep the upper part
            b.lo, b.below, b.inside = r["over"], r["upto"], end - r["upto"]
        else:
            b.lo, b.hi, b.below, b.inside = lo, hi, r["below"], r["upto"] - r["below"]
            if group and lo != hi and b.inside <= finish_rows:
                ready.append(k)
        if b.lo == b.hi or math.isnan(b.lo):     # NaN is the largest value
            b.value = b.lo
    _finish(found, plans, [k for k in ready if plans[k][0].value is None])


def _finish(found, plans, ready):
    """Pick the sought ranks among the grouped values of small ranges."""
    if not ready:
        return
    rest = F.create_map(*[F.lit(x) for k in ready for x in (k, plans[k][0].rank - plans[k][0].below)])
    counts = (found.filter(F.col("n").isNotNull() & F.col("k").isin(ready)).groupBy("k", "v").agg(F.sum("n").alias("n")))
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rest[F.col("k")]
    picked = (counts.withColumn("cum", F.sum("n").over(upto))
              .filter((F.col("cum") > wanted) & (F.col("cum") - F.col("n") <= wanted)))
    for row in picked.select("k", "v").collect():
        plans[row["k"]][0].value = row["v"]
