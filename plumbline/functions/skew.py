"""Joins whose many-row side may hold a third of its rows on one key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.functions.session import cut_lineage

# A key with more rows than this is split over several tasks.
ROWS_PER_KEY = 100_000
# The table of heavy keys is broadcast; it is counted first and never larger.
MOST_HEAVY = 10_000


def heavy_keys(many: DataFrame, on: list[str], rows_per_key: int = ROWS_PER_KEY,
               counts: DataFrame | None = None) -> DataFrame | None:
    """``on..., _parts``: keys with more than ``rows_per_key`` rows and the number of parts to make of each.

    Counts are combined before the shuffle.  The limit is raised until at most
    ``MOST_HEAVY`` keys are left, which happens by itself at ``rows / MOST_HEAVY``.
    None when no key is heavy.  ``counts`` (``on..., _n``) saves the count where the caller has it.
    """
    if counts is None:
        counts = many.groupBy(*[quoted(c) for c in on]).agg(F.count("*").alias("_n"))
    heavy = cut_lineage(counts.where(F.col("_n") > rows_per_key))
    while (found := heavy.count()) > MOST_HEAVY:
        rows_per_key *= 4
        heavy = heavy.where(F.col("_n") > rows_per_key)
    if not found:
        return None
    return heavy.select(*[quoted(c) for c in on], F.ceil(F.col("_n") / rows_per_key).cast("int").alias("_parts"))


def split_join(many: DataFrame, one: DataFrame, on: list[str], spread: Column, how: str = "inner",
               rows_per_key: int = ROWS_PER_KEY, counts: DataFrame | None = None) -> DataFrame:
    """``many.join(one, on, how)`` (inner, left, left_semi, left_anti) with the heavy keys of ``many`` dealt to several tasks.

    ``spread`` is any value that differs between the rows of one key (a row id, a
    position, a hash of the other columns).  Rows of ``one`` with a heavy key are
    repeated once per part.  Null keys match nothing; a heavy null key is split as
    any other.  No setting of adaptive execution is needed.
    """
    heavy = heavy_keys(many, on, rows_per_key, counts)
    if heavy is None:
        return many.join(one, on, how)
    keys = [quoted(c) for c in on]
    renamed = heavy.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(on)], "_parts")

    def marked(df: DataFrame) -> DataFrame:
        same = None
        for i, key in enumerate(keys):
            equal = key.eqNullSafe(F.col(f"_k{i}"))
            same = equal if same is None else same & equal
        return df.join(F.broadcast(renamed), same, "left").drop(*[f"_k{i}" for i in range(len(on))])

    part = F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)))
    left = marked(many).withColumn("_part", part.cast("int")).drop("_parts")
    right = (marked(one).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
             .drop("_parts"))
    return left.join(right, [*on, "_part"], how).drop("_part")
