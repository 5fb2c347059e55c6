"""Feature tables: imputation, category codes, scaling, folds."""

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import aggregate_long, as_double, as_text, kinds, quoted
from plumbline.functions.frequency import digest, text_counts
from plumbline.functions.ordered import running_sums
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.session import cut_lineage
from plumbline.operators.profile import Profile, moments

# A code table with at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_CODES = 200_000
ROW = "_rid"
ROWS_PER_TASK = 20_000
# Hashes of rows found more than once that travel to all tasks (8 bytes each); more of them meet the rows in a shuffle.
BROADCAST_HASHES = 1_000_000


def category_codes(df: DataFrame, columns: list[str], null_as: str) -> DataFrame:
    """``column, value, code``: the distinct values of each column numbered in sorted order."""
    counts = text_counts(df, columns, null_as=null_as)
    return (running_sums(counts, ["column"], ["value"], {"code": F.lit(1).cast("bigint")})
            .select("column", "value", "code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str], null_as: str,
                sizes: dict[str, int], unseen: int | None = None) -> DataFrame:
    """Replace each column by its code.

    ``sizes`` are the checked numbers of codes: only small tables are broadcast.
    """
    order = df.columns
    for c in columns:
        table = codes.filter(F.col("column") == c).select(F.col("value").alias("_v"), "code")
        if sizes.get(c, 0) <= BROADCAST_CODES:
            table = F.broadcast(table)
        text = F.coalesce(as_text(df, c), F.lit(null_as))
        code = F.col("code") if unseen is None else F.coalesce("code", F.lit(unseen))
        df = (df.withColumn("_v", text).join(table, "_v", "left")
              .withColumn(c, code).drop("_v", "code"))
    return df.select(*[quoted(c) for c in order])


@dataclass
class FeatureEncoder:
    """Median imputation of numbers and sorted integer codes of texts (null is ``NA``).

    ``coded`` names the columns to code; all others are numbers.
    """

    numbers: list[str]
    coded: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    codes: DataFrame | None = None

    def fit(self, df: DataFrame, n_rows: int | None = None) -> "FeatureEncoder":
        found = exact_quantiles(df, {c: as_double(c) for c in self.numbers}, [0.5], n_rows)
        self.medians = {c: v[0] if v[0] is not None else 0.0 for c, v in found.items()}
        if self.coded:
            self.codes = category_codes(df, self.coded, "NA")
            self.sizes = {r["column"]: r["n"] for r in
                          self.codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Unseen values get the code -1."""
        if self.coded:
            df = apply_codes(df, self.codes, self.coded, "NA", self.sizes, unseen=-1)
        return df.withColumns({
            **{c: F.coalesce(as_double(c), F.lit(self.medians[c])) for c in self.numbers},
            **{c: quoted(c).cast("double") for c in self.coded}})

    @property
    def columns(self) -> list[str]:
        return self.numbers + self.coded


def encoder_for(profile: Profile, by_view: bool = False) -> FeatureEncoder:
    """Encoder of the feature columns; numbers are told by type or, ``by_view``, by role."""
    if by_view:
        return FeatureEncoder(profile.numeric, profile.categorical)
    kind = profile.kinds
    return FeatureEncoder([c for c in profile.features if kind[c] == "numeric"],
                          [c for c in profile.features if kind[c] != "numeric"])


def feature_table(profile: Profile, *more: Column) -> DataFrame:
    """Feature columns and a row id, written once.

    Training reads the table many times, so the lineage is cut here.
    """
    cols = [quoted(c) for c in profile.features]
    return cut_lineage(with_row_ids(profile.df, cols + list(more)))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; equal rows share it."""
    return F.xxhash64(*[quoted(c) for c, kind in kinds(df).items() if kind != "unsupported"])


def with_row_ids(df: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """The rows (or the columns ``keep`` of them) with an id ``ROW`` of their own, the same for any partitioning.

    The id is a hash of the row and its occurrence number among equal rows, so
    a draw by id takes copies one by one, in proportion.  Occurrences are numbered
    inside a partition and shifted by the counts of the partitions before; a row on
    a third of the table is never gathered in one task.  Partition numbers are
    written to the checkpoint folder before use.
    """
    keep = [quoted(c) for c in df.columns] if keep is None else keep
    marked = cut_lineage(df.select(*keep, row_hash(df).alias("_same"), F.spark_partition_id().alias("_part")))
    counts = marked.groupBy("_same", "_part").agg(F.count("*").alias("_n"))
    # a row found once has the number 1; only rows found twice or more are numbered
    often = cut_lineage(counts.groupBy("_same").agg(F.sum("_n").alias("_all")).filter("_all > 1").select("_same"))
    n_often = often.count()
    small = F.broadcast(often) if n_often <= BROADCAST_HASHES else often
    single = (marked.join(small, "_same", "left_anti") if n_often else marked)
    first = single.withColumn(ROW, F.xxhash64("_same", F.lit(1).cast("bigint"))).drop("_same", "_part")
    if not n_often:
        return first
    some = marked.join(small, "_same", "left_semi")
    # one row per partition that holds the row at most
    before = Window.partitionBy("_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (counts.join(small, "_same", "left_semi")
              .select("_same", "_part", F.sum("_n").over(before).alias("_shift")).filter("_shift > 0"))
    inside = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_same"))
    numbered = (some.withColumn("_at", inside).join(shifts, ["_same", "_part"], "left")
                .withColumn(ROW, F.xxhash64("_same", F.col("_at") + F.coalesce("_shift", F.lit(0).cast("bigint"))))
                .drop("_same", "_part", "_at", "_shift"))
    return first.unionByName(numbered)


def encode_target(df: DataFrame, target: str) -> DataFrame:
    """``label, code, n``: sorted distinct labels numbered from 0; null targets dropped."""
    counts = (df.groupBy(quoted(target).alias("label")).agg(F.count("*").alias("n"))
              .filter("label is not null"))
    return running_sums(counts, [], ["label"], {"code": F.lit(1).cast("bigint")}) \
        .select(F.col("label").cast("string").alias("label"), "code", "n")


def assign_folds(df: DataFrame, k: int = 3, label: str | None = None, seed: int = 42,
                 rows_per_group: int = 200_000, n_rows: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1: shuffled, and balanced inside each label to one row.

    Rows are numbered inside (label, salt), so a label on a third of all rows
    is split over many tasks; the numbers go on from salt to salt of a label.
    """
    n_rows = df.count() if n_rows is None else n_rows
    salts = max(1, n_rows // rows_per_group)
    mixed = F.xxhash64(F.lit(seed), F.col(ROW))
    by = [quoted(label)] if label else []
    order = Window.partitionBy("_salt", *by).orderBy("_mix", ROW)
    salted = (df.withColumn("_mix", mixed)
              .withColumn("_salt", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(ROW)), F.lit(salts))))
    number = F.row_number().over(order)
    if salts > 1:
        # one row per label and salt: a row for every ``rows_per_group`` rows, or for every label
        before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        shifts = (salted.groupBy("_salt", *by).agg(F.count("*").alias("_n"))
                  .select(F.col("_salt").alias("_s"), *[c.alias("_l") for c in by],
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
        same = F.col("_salt") == F.col("_s")
        for c in by:
            same = same & c.eqNullSafe(F.col("_l"))
        salted = salted.withColumn("_number", number).join(shifts, same).drop("_s", "_l")
        number = F.col("_number") + F.col("_shift")
    return salted.withColumn("fold", (number % k).cast("int")).drop("_mix", "_salt", "_number", "_shift")


def subsample(df: DataFrame, run: int, share: float = 0.8, seed: int = 42) -> DataFrame:
    """A repeatable share of the rows, chosen by a hash of the row id and the run."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(run), F.col(ROW)), F.lit(10_000))
                     < int(share * 10_000))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    facts = {r["column"]: r for r in aggregate_long(df, {
        c: {"n": F.count(as_double(c)), "mean": F.avg(as_double(c)), "std": F.stddev_samp(as_double(c)),
            "min": F.min(as_double(c)), "max": F.max(as_double(c))} for c in columns}).collect()}
    out = {}
    for c in columns:
        n, mean, std = facts[c]["n"], facts[c]["mean"], facts[c]["std"]
        spread = std * ((n - 1) / n) ** 0.5 if n > 1 and std else 0.0
        low, high = facts[c]["min"], facts[c]["max"]
        out[c] = ((as_double(c) - F.lit(mean)) / F.lit(spread) if spread and low != high
                  else F.when(quoted(c).isNotNull(), F.lit(0.0)))
    return df.withColumns(out)


def top_variance_columns(df: DataFrame, columns: list[str], k: int = 50) -> DataFrame:
    """``column, variance`` of the k columns that vary most (all when there are no more than k)."""
    return (moments(df, columns).select("column", (F.col("std") * F.col("std")).alias("variance"))
            .orderBy(F.desc_nulls_last("variance"), "column").limit(k))


def with_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


def compact(df: DataFrame, n_rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """No more partitions than the rows are worth: a fit runs thousands of short jobs."""
    return df.coalesce(max(1, -(-n_rows // rows_per_task)))


def duplicate_rows(df: DataFrame, without: list[str] = ()) -> DataFrame:
    """``n_rows, n_repeats, duplicate_share``: rows equal to an earlier one (nulls are equal).

    Rows shrink to 128-bit keys before the shuffle.
    """
    cols = [quoted(c) for c in df.columns if c not in without and kinds(df)[c] != "unsupported"]
    groups = df.select(digest(*cols).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeats")) \
        .withColumn("duplicate_share", F.try_divide("n_repeats", "n_rows"))
