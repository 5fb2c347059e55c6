"""Correlation between columns and with the target; target insight; bucketed target."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import STANDARD, Thresholds
from plumbline.functions.columns import (aggregate_long, as_double, as_text, kinds, quoted,
                                         unfold)
from plumbline.functions.frequency import distinct_counts
from plumbline.functions.gram import pair_sums, pearson_pairs
from plumbline.functions.ordered import running_sums
from plumbline.functions.session import cut_lineage
from plumbline.functions.skew import split_join
from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators.profile import (Profile, corrected_kurtosis, corrected_skewness, moments)

# Up to so many values with their ranks travel to the pairs; more of them meet in a join.
BROADCAST_RANKS = 100_000

# A class column with more values than this is a regression target.
MAX_CLASSES = 20


# ---- between columns ----

def corr_matrix(df: DataFrame, columns: list[str], means: dict[str, float | None]) -> DataFrame:
    """``col_a, col_b, value``: absolute Pearson correlation of every pair."""
    return (pearson_pairs(df, columns, means)
            .select("col_a", "col_b", F.abs("value").alias("value")))


def feature_redundancy(df: DataFrame, columns: list[str], means: dict[str, float | None],
                       config: Thresholds = STANDARD) -> DataFrame:
    """Pairs over the profile's correlation threshold."""
    return corr_matrix(df, columns, means).filter(F.col("value") > config.correlation)


def redundancy_risk(pairs: DataFrame) -> DataFrame:
    """``n_pairs, overall_risk`` from the rows of ``feature_redundancy``."""
    return (pairs.agg(F.count("*").alias("n_pairs"))
            .withColumn("overall_risk", F.when(F.col("n_pairs") > 0, "High").otherwise("Low")))


def feature_similarity(df: DataFrame, columns: list[str], n_rows: int | None = None,
                       threshold: float = 0.85) -> DataFrame:
    """``col_a, col_b, value, strength, implication``: cosine between robustly scaled columns."""
    # filling with the median leaves the median where it is, but can move the quartiles
    medians = {c: v[0] for c, v in exact_quantiles(
        df, {c: as_double(c) for c in columns}, [0.5], n_rows).items()}
    known = [c for c in columns if medians[c] is not None]
    filled = df.select(*[F.coalesce(as_double(c), F.lit(medians[c])).alias(c) for c in known])
    quart = exact_quantiles(filled, {c: as_double(c) for c in known}, [0.25, 0.75], n_rows)
    scaled = filled.select(*[
        ((quoted(c) - medians[c]) / ((quart[c][1] - quart[c][0]) or 1.0)).alias(c) for c in known])
    sums = pair_sums(scaled, known, {})
    label = lambda c: F.element_at(F.array(*[F.lit(n) for n in known]), F.col(c) + 1)
    value = F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy"))
    return (sums.filter("i < j").select(label("i").alias("col_a"), label("j").alias("col_b"),
                                        value.alias("value"))
            .filter(F.col("value") > threshold)
            .select("col_a", "col_b", F.round("value", 3).alias("value"),
                    F.when(F.col("value") > 0.95, "very_high").otherwise("high").alias("strength"),
                    F.when(F.col("value") > 0.9, "multicollinearity_risk")
                    .otherwise("redundant_information").alias("implication")))


# ---- with the target ----

class Target:
    """The target column, its task type and its numeric form.

    Two classes become 1 for the commoner and 0 for the other.  More classes
    that are not numbers get the rank of their label; those codes are arbitrary
    and flagged so.
    """

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = df, name
        self.kind = kinds(df)[name]
        facts = distinct_counts(df, [name]).first()
        self.n_classes = facts["n_distinct"] if facts else 0
        self.classification = self.kind != "numeric" or self.n_classes <= MAX_CLASSES
        self.arbitrary_codes = False
        self.mapping: dict[str, float] = {}
        self.ranks: DataFrame | None = None
        if self.kind != "numeric":
            self._encode()

    def _encode(self):
        as_number = as_text(self.df, self.name).try_cast("double")
        if self.df.agg(F.count(as_number)).first()[0]:
            return
        counts = (self.df.groupBy(as_text(self.df, self.name).alias("label"))
                  .agg(F.count("*").alias("n")).filter("label is not null"))
        if self.n_classes == 2:
            top, other = [r["label"] for r in counts.orderBy(F.desc("n"), "label").collect()]
            self.mapping = {top: 1.0, other: 0.0}
            return
        self.arbitrary_codes = True
        if self.n_classes <= 1000:
            labels = [r["label"] for r in counts.orderBy("label").collect()]
            self.mapping = {v: float(i) for i, v in enumerate(labels)}
        else:
            # too many labels for a literal: number them in order and join
            self.ranks = running_sums(counts, [], ["label"], {"code": F.lit(1).cast("double")})

    def numeric(self) -> Column:
        """The numeric form as an expression (``with_numeric`` covers every case)."""
        if self.kind == "numeric":
            return as_double(self.name)
        text = as_text(self.df, self.name)
        if self.mapping:
            cells = [F.lit(x) for kv in self.mapping.items() for x in kv]
            return F.create_map(*cells)[text]
        return text.try_cast("double")

    def with_numeric(self, name: str = "_y") -> DataFrame:
        if self.ranks is None:
            return self.df.withColumn(name, self.numeric())
        return (self.df.withColumn("_label", as_text(self.df, self.name))
                .join(self.ranks.select(F.col("label").alias("_label"), F.col("code").alias(name)),
                      "_label", "left").drop("_label"))


def target_encoding(target: Target) -> DataFrame:
    """``label, code, n`` of the target's numeric form."""
    return (target.with_numeric("code").filter(quoted(target.name).isNotNull())
            .groupBy(as_text(target.df, target.name).alias("label"), "code")
            .agg(F.count("*").alias("n")))


def target_pearson(target: Target, columns: list[str]) -> DataFrame:
    """``column, pearson, arbitrary_codes``: over rows where column and target are present."""
    per = {}
    y = F.col("_y")
    for c in columns:
        x = as_double(c)
        xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        per[c] = {"pearson": F.try_divide(F.covar_samp(xs, ys),
                                          F.stddev_samp(xs) * F.stddev_samp(ys))}
    return (aggregate_long(target.with_numeric(), per, buffers=10)
            .withColumn("arbitrary_codes", F.lit(target.arbitrary_codes)))


def target_spearman(target: Target, columns: list[str]) -> DataFrame:
    """``column, spearman``: correlation of average ranks on pairwise-complete rows.

    Rows shrink to (column, x, y, count) first.  Ranks of the distinct x and y
    come from running counts over range-partitioned values and are joined back,
    so no column is ever sorted in one task.
    """
    rows = [[F.lit(c), as_double(c), F.col("_y")] for c in columns]
    # read for the ranks of x, of y, the mean rank and the join
    pairs = cut_lineage(unfold(target.with_numeric(), rows, ["column", "x", "y"])
                        .filter("x is not null and y is not null")
                        .groupBy("column", "x", "y").agg(F.count("*").alias("n")))
    ranked = pairs
    for v in ("x", "y"):
        counts = cut_lineage(pairs.groupBy("column", v).agg(F.sum("n").alias("c"), F.count("*").alias("_n")))
        rank = F.col("before") + (F.col("c") + 1) / 2
        ranks = (running_sums(counts, ["column"], [v], {"before": F.col("c")})
                 .select("column", v, rank.alias(f"r{v}")))
        if counts.count() <= BROADCAST_RANKS:
            ranked = ranked.join(F.broadcast(ranks), ["column", v])
        else:       # a value on a third of all rows meets its rank in many tasks
            ranked = split_join(ranked, ranks, ["column", v], F.struct("x", "y"), counts=counts.select("column", v, "_n"))
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    # ranks are centred by the known mean rank (N + 1) / 2 before they are squared
    mid = pairs.groupBy("column").agg(((F.sum("n") + 1) / 2).alias("mid"))
    dx, dy = rx - F.col("mid"), ry - F.col("mid")
    return (ranked.join(F.broadcast(mid), "column").groupBy("column")
            .agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"),
                 F.sum(n * dy * dy).alias("yy"))
            .select("column", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("spearman")))


def _category_cells(df: DataFrame, columns: list[str], *others: Column) -> DataFrame:
    rows = [[F.lit(c), as_text(df, c)] for c in columns]
    return unfold(df, rows, ["column", "value"], list(others)).filter("value is not null")


def category_impact_regression(target: Target, columns: list[str]) -> DataFrame:
    """``column, max_mean_shift, explained_variance_ratio, likely_influential``."""
    df = target.with_numeric()
    overall = df.agg(F.avg("_y").alias("m"), F.var_samp("_y").alias("v")).first()
    means = (_category_cells(df, columns, F.col("_y")).groupBy("column", "value")
             .agg(F.avg("_y").alias("mean")))
    ratio = (F.var_samp("mean") / F.lit(overall["v"])) if (overall["v"] or 0) > 0 else F.lit(0.0)
    return (means.groupBy("column")
            .agg(F.max(F.abs(F.col("mean") - F.lit(overall["m"]))).alias("max_mean_shift"),
                 ratio.alias("explained_variance_ratio"))
            .withColumn("likely_influential",
                        F.coalesce(F.col("explained_variance_ratio") > 0.02, F.lit(False))))


def category_impact_classification(target: Target, columns: list[str]) -> DataFrame:
    """``column, shift_ref, shift_tv, likely_influential``.

    The largest distance between the class shares inside one category and
    overall.  ``shift_ref`` looks only at the classes the category contains;
    ``shift_tv`` is the full total variation distance, in which absent classes
    count with their overall share.
    """
    df, label = target.df, as_text(target.df, target.name).alias("cls")
    overall = (df.groupBy(label).agg(F.count("*").alias("n")).filter("cls is not null"))
    total = overall.agg(F.sum("n")).first()[0] or 0
    overall = overall.select("cls", (F.col("n") / F.lit(total)).alias("share_all"))
    # read for the sizes, the frequent classes and the join
    counts = cut_lineage(_category_cells(df, columns, label).filter("cls is not null")
                         .groupBy("column", "value", "cls").agg(F.count("*").alias("n")))
    # partial sums per (column, value) instead of a window over them
    sizes = counts.groupBy("column", "value").agg(F.sum("n").alias("size"))
    gap = F.abs(F.col("n") / F.col("size") - F.col("share_all"))
    shifts = (split_join(counts, overall, ["cls"], F.struct("column", "value")).join(sizes, ["column", "value"])
              .groupBy("column", "value")
              .agg((F.sum(gap) / 2).alias("ref"),
                   ((F.sum(gap) + (1 - F.sum("share_all"))) / 2).alias("tv")))
    return (shifts.groupBy("column")
            .agg(F.max("ref").alias("shift_ref"), F.max("tv").alias("shift_tv"))
            .withColumn("likely_influential", F.col("shift_ref") > 0.3))


# ---- target insight ----

def target_task_type(target: Target) -> DataFrame:
    """``target, task_type, missing_pct``."""
    return target.df.agg(
        F.lit(target.name).alias("target"),
        F.lit("classification" if target.classification else "regression").alias("task_type"),
        (F.avg(quoted(target.name).isNull().cast("int")) * 100).alias("missing_pct"))


def class_balance(target: Target) -> DataFrame:
    """``class, n, share, imbalance_ratio, is_imbalanced``."""
    counts = (target.df.groupBy(as_text(target.df, target.name).alias("class"))
              .agg(F.count("*").alias("n")).filter("class is not null"))
    ends = counts.agg(F.sum("n").alias("t"), F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    if not ends["t"]:
        return counts.limit(0).select("class", "n", F.lit(0.0).alias("share"),
                                      F.lit(0.0).alias("imbalance_ratio"),
                                      F.lit(False).alias("is_imbalanced"))
    return counts.select("class", "n", (F.col("n") / F.lit(ends["t"])).alias("share"),
                         F.lit(ends["hi"] / ends["lo"]).alias("imbalance_ratio"),
                         F.lit(ends["hi"] / ends["t"] > 0.7).alias("is_imbalanced"))


def feature_separation(target: Target, columns: list[str]) -> DataFrame:
    """``class, column, mean, std`` of numeric features."""
    aggs = [a for i, c in enumerate(columns) for a in (
        F.avg(as_double(c)).alias(f"m{i}"), F.stddev_samp(as_double(c)).alias(f"s{i}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.round(f"m{i}", 3).alias("mean"),
                              F.round(f"s{i}", 3).alias("std")) for i, c in enumerate(columns)])
    return (target.df.groupBy(as_text(target.df, target.name).alias("class")).agg(*aggs)
            .filter("class is not null").select("class", F.inline(rows)))


def target_stats(target: Target) -> DataFrame:
    """``mean, std, skewness, kurtosis, transform_needed`` of a numeric target."""
    skew = corrected_skewness(F.col("skew_pop"), F.col("n"))
    return (moments(target.df, [target.name])
            .select("mean", "std", skew.alias("skewness"),
                    corrected_kurtosis(F.col("kurt_pop"), F.col("n")).alias("kurtosis"),
                    F.coalesce(F.abs(skew) > 1, F.lit(False)).alias("transform_needed")))


# ---- bucketed target ----

def quintile_edges(df: DataFrame, columns: list[str], n_rows: int | None = None,
                   buckets: int = 5) -> dict[str, list[float]]:
    """Distinct quantile edges of the numeric features with enough distinct values."""
    enough = {r["column"] for r in distinct_counts(df, columns).collect() if r["n_distinct"] >= 5}
    probs = [i / buckets for i in range(buckets + 1)]
    found = exact_quantiles(df, {c: as_double(c) for c in columns if c in enough}, probs, n_rows)
    return {c: sorted(set(v)) for c, v in found.items()}


def _bucketed(df: DataFrame, edges: dict[str, list[float]], *others: Column) -> DataFrame:
    """(others..., column, bucket, lo, hi): right-closed buckets, lowest value included."""
    rows = []
    for c, e in edges.items():
        x = as_double(c)
        bucket = F.lit(0)
        for inner in e[1:-1]:
            bucket = bucket + (x > inner).cast("int")
        rows.append([F.lit(c), F.when(x.isNotNull(), bucket)])
    lo = F.create_map(*[k for c, e in edges.items() for k in (
        F.lit(c), F.array(*[F.lit(float(x)) for x in e]))])[F.col("column")]
    names = df.select(*others).columns if others else []
    return (unfold(df, rows, ["column", "bucket"], list(others)).filter("bucket is not null")
            .select(*names, "column", "bucket", F.element_at(lo, F.col("bucket") + 1).alias("lo"),
                    F.element_at(lo, F.col("bucket") + 2).alias("hi")))


def quintile_buckets(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``column, bucket, lo, hi, n``."""
    return _bucketed(df, edges).groupBy("column", "bucket", "lo", "hi").agg(F.count("*").alias("n"))


def bivariate_classification(target: Target, edges: dict[str, list[float]]) -> DataFrame:
    """``column, bucket, lo, hi, class, share``; a class absent from a bucket has share 0."""
    label = as_text(target.df, target.name).alias("class")
    keys = ["column", "bucket", "lo", "hi"]
    counts = (_bucketed(target.df, edges, label).filter("class is not null")
              .groupBy(*keys, "class").agg(F.count("*").alias("n")))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    # every class beside every bucket; the buckets are a few literals per column
    every = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("bucket"))
                      for c, e in edges.items() for i in range(max(1, len(e) - 1))])
    grid = (counts.select("class").distinct().select("class", F.inline(every))
            .join(F.broadcast(sizes), ["column", "bucket"]).select(*keys, "size", "class"))
    return (grid.join(counts, [*keys, "class"], "left")
            .select(*keys, "class",
                    F.round(F.coalesce("n", F.lit(0)) / F.col("size"), 3).alias("share")))


def bivariate_regression(target: Target, edges: dict[str, list[float]]) -> DataFrame:
    """``column, bucket, lo, hi, mean, std`` of the target per bucket."""
    return (_bucketed(target.df, edges, as_double(target.name).alias("_y"))
            .groupBy("column", "bucket", "lo", "hi")
            .agg(F.round(F.avg("_y"), 3).alias("mean"), F.round(F.stddev_samp("_y"), 3).alias("std")))


def target_report(profile: Profile) -> dict[str, DataFrame]:
    """All target results of a labeled table."""
    df, target = profile.df, Target(profile.df, profile.target)
    numeric, categorical = profile.numeric, profile.categorical
    keys = [c for c in profile.view("entity_key") if profile.kinds[c] == "numeric"]
    out = {"target_task_type": target_task_type(target)}
    if numeric + keys:
        out["target_pearson"] = target_pearson(target, numeric + keys)
        out["target_spearman"] = target_spearman(target, numeric + keys)
    if categorical:
        out["category_impact"] = (category_impact_classification(target, categorical)
                                  if target.classification
                                  else category_impact_regression(target, categorical))
    edges = quintile_edges(df, numeric, profile.n_rows) if numeric else {}
    if target.classification:
        out["class_balance"] = class_balance(target)
        if numeric:
            out["feature_separation"] = feature_separation(target, numeric)
        if edges:
            out["bivariate"] = bivariate_classification(target, edges)
    else:
        out["target_stats"] = target_stats(target)
        if edges:
            out["bivariate"] = bivariate_regression(target, edges)
    return out
