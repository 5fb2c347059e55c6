"""Numeric summaries, outliers and structural health."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import STANDARD, Thresholds
from plumbline.functions.columns import aggregate_long, as_double, as_text, quoted, unfold, union_all
from plumbline.functions.frequency import distinct_counts
from plumbline.functions.gram import pearson_pairs
from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators.profile import (Profile, corrected_kurtosis, corrected_skewness, moments)


def _quantile_columns(df, columns, probs, n_rows, names):
    """(column, one double per probability) as a table of O(columns) rows."""
    found = exact_quantiles(df, {c: as_double(c) for c in columns}, probs, n_rows)
    return df.sparkSession.createDataFrame(
        [(c, *v) for c, v in found.items()],
        "column string, " + ", ".join(f"{n} double" for n in names))


def numeric_summary(df: DataFrame, columns: list[str], n_rows: int | None = None) -> DataFrame:
    """Count, mean, sd, range, quartiles, skewness, zero fraction, null percent per column.

    Constant columns are left out.
    """
    quart = _quantile_columns(df, columns, [0.25, 0.75], n_rows, ["q1", "q3"])
    out = (moments(df, columns).filter("n = 0 or min < max").join(F.broadcast(quart), "column")
           .select("column", F.col("n").alias("count"), "mean", "std", "min", "max", "q1", "q3",
                   (F.col("q3") - F.col("q1")).alias("iqr"),
                   corrected_skewness(F.col("skew_pop"), F.col("n")).alias("skewness"),
                   F.try_divide("n_zero", "n_rows").alias("zero_frac"),
                   (100 - F.try_divide(F.col("n") * 100, "n_rows")).alias("missing_pct")))
    return out


def skew_ranking(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, skewness`` by absolute skewness, largest first."""
    skew = F.round(corrected_skewness(F.col("skew_pop"), F.col("n")), 3)
    return (moments(df, columns).select("column", skew.alias("skewness"))
            .filter("skewness is not null").orderBy(F.desc(F.abs("skewness")), "column"))


def skew_kurtosis(df: DataFrame, columns: list[str], min_distinct: int = 10) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of columns with enough distinct values."""
    many = distinct_counts(df, columns).filter(F.col("n_distinct") >= min_distinct)
    return (moments(df, columns).join(F.broadcast(many), "column")
            .select("column",
                    corrected_skewness(F.col("skew_pop"), F.col("n")).alias("skewness"),
                    corrected_kurtosis(F.col("kurt_pop"), F.col("n")).alias("kurtosis")))


def iqr_outliers(df: DataFrame, columns: list[str], n_rows: int | None = None) -> DataFrame:
    """``column, outlier_pct``: share outside 1.5 interquartile ranges from the quartiles."""
    quart = exact_quantiles(df, {c: as_double(c) for c in columns}, [0.25, 0.75], n_rows)
    per = {}
    for c, (q1, q3) in quart.items():
        if q1 is None:
            continue
        iqr = q3 - q1
        outside = ~as_double(c).between(q1 - 1.5 * iqr, q3 + 1.5 * iqr)
        per[c] = {"outlier_pct": F.round(F.avg(outside.cast("int")) * 100, 2)}
    return aggregate_long(df, per)


def outlier_report(df: DataFrame, columns: list[str], n_rows: int | None = None) -> DataFrame:
    """Skewness, kurtosis, outlier share and the advice that follows from them."""
    s, k = F.col("skewness"), F.col("kurtosis")
    heavy = F.coalesce(F.abs(k) > 3, F.lit(False))
    gaussian = F.coalesce((F.abs(s) < 0.5) & (F.abs(k) < 1), F.lit(False))
    return (skew_kurtosis(df, columns).join(F.broadcast(iqr_outliers(df, columns, n_rows)), "column")
            .select("column", "skewness", "kurtosis", "outlier_pct",
                    F.when(gaussian, "Gaussian-like").otherwise("Heavy-tailed / Skewed")
                    .alias("distribution_type"),
                    heavy.alias("heavy_tailed"),
                    (heavy & F.coalesce(s > 1, F.lit(False))).alias("suggest_log_transform"),
                    (heavy & F.coalesce(F.abs(s) <= 1, F.lit(False))).alias("suggest_robust_loss")))


def outliers_are_signal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table verdict: ``n_heavy, n_safe, outliers_are_signal``."""
    heavy = F.coalesce(F.abs(F.col("kurtosis")) > 3, F.lit(False))
    return (skew_kurtosis(df, columns)
            .agg(F.count_if(heavy).alias("n_heavy"), F.count_if(~heavy).alias("n_safe"))
            .withColumn("outliers_are_signal", F.col("n_heavy") > 0))


def monotonic_increasing(df: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """``column, monotonic``: no value falls (and none is null) in the order of ``order_col``.

    Rows are range-partitioned by (column, order); every task walks its sorted
    share once and reports its first value, last value and whether it was in
    order, so nothing needs the whole column in one place.
    """
    rows = unfold(df, [[F.lit(c), quoted(order_col), as_double(c)] for c in columns],
                  ["column", "at", "x"])
    ordered = (rows.repartitionByRange("column", "at", "x")
               .sortWithinPartitions("column", "at", "x")
               .select("column", "x", F.spark_partition_id().alias("chunk")))

    def walk(batches):
        import pandas as pd
        seen: dict[tuple, list] = {}
        for pdf in batches:
            for (name, chunk), part in pdf.groupby(["column", "chunk"], sort=False):
                x = part["x"]
                ok = bool(x.notna().all() and x.is_monotonic_increasing)
                if (name, chunk) in seen:
                    s = seen[name, chunk]
                    s[2] = s[2] and ok and bool(s[1] <= x.iloc[0])
                    s[1] = x.iloc[-1]
                else:
                    seen[name, chunk] = [x.iloc[0], x.iloc[-1], ok]
        yield pd.DataFrame([(n, c, *s) for (n, c), s in seen.items()],
                           columns=["column", "chunk", "first", "last", "ok"])

    parts = ordered.mapInPandas(
        walk, "column string, chunk int, first double, last double, ok boolean")
    # at most one row per partition and column
    before = F.lag("last").over(Window.partitionBy("column").orderBy("chunk"))
    return (parts.withColumn("joint", F.coalesce(before <= F.col("first"), before.isNull()))
            .groupBy("column").agg(F.bool_and(F.col("ok") & F.col("joint")).alias("monotonic")))


def drop_candidates(df: DataFrame, columns: list[str], order_col: str | None = None) -> DataFrame:
    """``column, action, reason`` for columns to drop; the first matching reason counts.

    Without ``order_col`` the table has no row order and the monotonic rule is skipped.
    """
    facts = (moments(df, columns).select("column", "n_rows", "n", "n_zero")
             .join(F.broadcast(distinct_counts(df, columns)), "column", "left")
             .withColumn("present", F.coalesce("n_distinct", F.lit(0)))
             .withColumn("d", F.col("present") + (F.col("n") < F.col("n_rows")).cast("int")))
    if order_col is None:
        facts = facts.withColumn("monotonic", F.lit(False))
    else:
        facts = facts.join(F.broadcast(monotonic_increasing(df, columns, order_col)), "column", "left")
    reason = (F.when(F.col("monotonic") & (F.col("d") / F.col("n_rows") > 0.95), "monotonic")
              .when(F.col("d") <= 1, "constant")
              .when(1 - F.col("n") / F.col("n_rows") > 0.7, "mostly_missing")
              .when((F.col("n_zero") / F.col("n_rows") > 0.95) & (F.col("present") > 2),
                    "mostly_zero"))
    return (facts.withColumn("reason", reason).filter("reason is not null")
            .select("column", F.lit("drop").alias("action"), "reason"))


def log_candidates(df: DataFrame, columns: list[str], config: Thresholds = STANDARD,
                   dropped: list[str] = ()) -> DataFrame:
    """``column, action, reason``: columns whose skew (nulls as 0) asks for ``log`` or ``log1p``."""
    columns = [c for c in columns if c not in dropped]
    filled = df.select(*[F.coalesce(as_double(c), F.lit(0.0)).alias(c) for c in columns])
    skew = corrected_skewness(F.col("skew_pop"), F.col("n"))
    bounded = (F.col("min") >= -180) & (F.col("max") <= 180) & (F.col("mean") != 0)
    return (moments(filled, columns)
            .join(F.broadcast(distinct_counts(filled, columns).filter("n_distinct >= 10")), "column")
            .filter((skew > config.skew) & ~bounded)
            .select("column", F.when(F.col("n_zero") > 0, "log1p").otherwise("log").alias("action"),
                    F.lit("skewed").alias("reason")))


def redundant_columns(df: DataFrame, columns: list[str], means: dict[str, float | None],
                      threshold: float = 0.98, dropped: list[str] = ()) -> DataFrame:
    """``redundant_column, base_column, value, alert``: near-copies of an earlier column."""
    found = (pearson_pairs(df, columns, means).withColumn("value", F.abs("value"))
             .filter((F.col("value") > threshold) & ~F.col("col_b").isin(list(dropped))))
    alert = F.concat(F.lit("Redundant feature: '"), F.col("col_b"), F.lit("' is "),
                     F.format_string("%.2f", "value"), F.lit(" correlated with '"),
                     F.col("col_a"), F.lit("'"))
    return found.select(F.col("col_b").alias("redundant_column"),
                        F.col("col_a").alias("base_column"), "value", alert.alias("alert"))


def categorical_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, issue, value``: too many distinct values or one dominant value (null is a value)."""
    filled = df.select(*[F.coalesce(as_text(df, c), F.lit("nan")).alias(c) for c in columns])
    facts = distinct_counts(filled, columns)
    ratio, top = F.col("n_distinct") / F.col("n_present"), F.col("top_n") / F.col("n_present")
    issues = F.array(
        F.struct(F.lit("high_cardinality").alias("issue"), F.when(ratio > 0.8, ratio).alias("value")),
        F.struct(F.lit("near_zero_variance").alias("issue"), F.when(top > 0.99, top).alias("value")))
    return facts.select("column", F.inline(issues)).filter("value is not null")


def structural_score(drops: DataFrame, n_columns: int) -> DataFrame:
    """``score``: percentage of columns kept, from the rows of ``drop_candidates``."""
    return drops.agg(F.floor(100 * (1 - F.count_distinct("column") / F.lit(max(1, n_columns))))
                     .cast("int").alias("score"))


def data_health_report(profile: Profile, order_col: str | None = None) -> DataFrame:
    """``kind, column, detail``: drops, transforms, redundancy, categorical issues and score."""
    df, numbers = profile.df, profile.numeric
    drops = drop_candidates(df, numbers, order_col)
    dropped = [r["column"] for r in drops.collect()]
    frames = [
        drops.select(F.lit("drop").alias("kind"), "column", F.col("reason").alias("detail")),
        log_candidates(df, numbers, profile.config, dropped)
        .select(F.col("action").alias("kind"), "column", F.col("reason").alias("detail")),
        categorical_health(df, profile.categorical)
        .select(F.col("issue").alias("kind"), "column", F.round("value", 4).cast("string").alias("detail")),
        structural_score(drops, len(df.columns))
        .select(F.lit("structural_score").alias("kind"), F.lit(None).cast("string").alias("column"),
                F.col("score").cast("string").alias("detail")),
    ]
    if len(numbers) >= 2:
        frames.append(redundant_columns(df, numbers, profile.means, dropped=dropped).select(
            F.lit("redundant").alias("kind"), F.col("redundant_column").alias("column"),
            F.col("alert").alias("detail")))
    return union_all(frames).distinct().orderBy("kind", "column")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, bin_start, n``: equal-width counts, the maximum in the last bin, empty bins included."""
    x = as_double(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, n bigint")
    if low == high:
        return (df.filter(x.isNotNull()).groupBy(F.lit(0).alias("bin"), F.lit(low).alias("bin_start"))
                .agg(F.count("*").alias("n")))
    width = (high - low) / bins
    index = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            .join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"),
                    F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))
