"""Work that needs an order, without putting a whole group into one task.

A group (one series, one column) may hold a large part of all rows, so no window
here is partitioned by the group alone.  Rows are range-partitioned by
(group, order); the partition number is the chunk.  Chunk totals give each chunk
its starting offset and windows then run inside one (group, chunk).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, unfold
from plumbline.functions.session import cut_lineage

# Rows of a group that one window or one Python call sees.
CHUNK_ROWS = 4096


def running_sums(df: DataFrame, by: list[str], order: list[str],
                 sums: dict[str, Column]) -> DataFrame:
    """Add, per row, the sum of each expression over the earlier rows of its group.

    ``order`` must be unique within a group.  The chunk numbers are written to
    the checkpoint folder before use: range bounds come from a sample and could
    differ between two evaluations.
    """
    cols = df.columns
    staged = df.withColumns({f"_v_{k}": e for k, e in sums.items()})
    chunked = cut_lineage(
        staged.repartitionByRange(*[quoted(c) for c in by + order])
        .withColumn("_chunk", F.spark_partition_id()))
    keys = [*by, "_chunk"]
    totals = chunked.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    # at most one row per chunk and group: bounded by the number of partitions
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_t_{k}").over(earlier), F.col(f"_t_{k}") * 0).alias(f"_o_{k}")
        for k in sums])
    inside = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return chunked.join(offsets, keys).select(*cols, *[
        (F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.col(f"_v_{k}") * 0)).alias(k)
        for k in sums])


def with_position(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in its group."""
    return running_sums(df, by, order, {name: F.lit(1).cast("bigint")})


def overlapped(df: DataFrame, by: list[str], pos: str = "pos", before: int = 0, after: int = 0,
               rows: int = CHUNK_ROWS) -> DataFrame:
    """Split groups into chunks of consecutive positions with shared edges.

    Each row goes to its own chunk (``_own`` true) and, when it lies within
    ``before`` rows ahead of the next chunk or ``after`` rows behind the
    previous one, also there.  A window over (by, ``_chunk``) then sees all the
    neighbours a row needs and never more than ``rows + before + after`` rows.
    """
    rows = max(rows, before, after, 1)
    p = F.col(pos)
    home = F.floor(p / rows).cast("bigint")
    inside = p - home * rows
    rows_ = [[home, F.lit(True)]]
    if before:
        rows_.append([F.when(inside >= rows - before, home + 1), F.lit(False)])
    if after:
        rows_.append([F.when((inside < after) & (home > 0), home - 1), F.lit(False)])
    return (unfold(df, rows_, ["_chunk", "_own"], [quoted(c) for c in df.columns])
            .filter("_chunk is not null"))


def chunk_window(by: list[str], pos: str = "pos") -> Window:
    return Window.partitionBy(*by, "_chunk").orderBy(pos)


def order_statistics(counts: DataFrame, by: list[str], value: str, n: str,
                     probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from a table of value counts.

    Returns one row per group with a column for each named probability.
    """
    totals = counts.groupBy(*by).agg(F.sum(n).alias("_total"))
    placed = (running_sums(counts, by, [value], {"_before": F.col(n)})
              .join(totals, by))
    picks = []
    for name, p in probs.items():
        rank = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.floor(rank), F.ceil(rank)
        covers = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col(n))
        low = F.max(F.when(covers(lo), F.col(value)))
        high = F.max(F.when(covers(hi), F.col(value)))
        weight = F.max(rank - lo)
        picks.append((low + (high - low) * weight).alias(name))
    return placed.groupBy(*by).agg(*picks)
