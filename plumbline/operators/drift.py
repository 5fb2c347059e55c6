"""Train/test drift."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import aggregate_long, kinds, normalise, quoted, union_all
from plumbline.functions.frequency import distinct_counts, number_counts, text_counts
from plumbline.functions.ordered import running_sums

DRIFTED = 25
REPORT_SCHEMA = ["column", "kind", "train_missing", "test_missing", "delta", "ks_statistic",
                 "ks_pvalue", "train_mean", "test_mean", "mean_shift_pct", "distribution_shift",
                 "new_category_count", "drift_score", "severity", "status"]


def drift_columns(train: DataFrame, test: DataFrame) -> list[tuple[str, str, str]]:
    """(column, kind, status) of the columns compared: in both tables, not near-unique in train."""
    train, test = normalise(train), normalise(test)
    k1, k2 = kinds(train), kinds(test)
    common = [c for c in train.columns if c in k2 and k1[c] != "unsupported"]
    if not common:
        return []
    n_rows = train.count()
    distinct = {r["column"]: r["n_distinct"] for r in distinct_counts(train, common).collect()}
    out = []
    for c in common:
        if distinct.get(c, 0) / max(1, n_rows) < 0.95:
            kind = "numeric" if k1[c] == "numeric" else "categorical"
            clash = kind == "numeric" and k2[c] != "numeric"
            out.append((c, kind, "type_mismatch" if clash else "ok"))
    return out


def missing_rates(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, train_missing, test_missing, delta``."""
    rate = lambda df, name: aggregate_long(df, {c: {name: F.avg(quoted(c).isNull().cast("int"))}
                                                for c in columns})
    return (rate(train, "train_missing").join(F.broadcast(rate(test, "test_missing")), "column")
            .withColumn("delta", F.col("test_missing") - F.col("train_missing")))


def missing_rate_delta(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, delta`` of the columns whose null share moved by more than 0.01."""
    return (missing_rates(train, test, columns).filter(F.abs("delta") > 0.01)
            .select("column", F.round("delta", 4).alias("delta")))


def _both_sides(train: DataFrame, test: DataFrame) -> DataFrame:
    """``column, value, n_train, n_test`` from the value counts of the two tables.

    A union with one aggregate does the work of a full outer join in one shuffle.
    """
    zero = F.lit(0).cast("bigint")
    sides = union_all([train.withColumnsRenamed({"n": "n_train"}).withColumn("n_test", zero),
                       test.withColumnsRenamed({"n": "n_test"}).withColumn("n_train", zero)])
    return sides.groupBy("column", "value").agg(F.sum("n_train").alias("n_train"),
                                                F.sum("n_test").alias("n_test"))


def ks_pvalue(d, n, m):
    """Asymptotic two-sample p-value: the Kolmogorov series at D sqrt(nm / (n + m))."""
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(
        k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    # below this point the probability is 1 to ten digits and the series is slow
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def numeric_drift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, ks_statistic, ks_pvalue, train_mean, test_mean, drift_score``.

    Values shrink to distinct values with two counts; cumulative shares come
    from running counts over range-partitioned values.
    """
    counts = _both_sides(number_counts(train, columns), number_counts(test, columns))
    totals = counts.groupBy("column").agg(
        F.sum("n_train").cast("double").alias("n"), F.sum("n_test").cast("double").alias("m"),
        F.sum(F.col("value") * F.col("n_train")).alias("s1"),
        F.sum(F.col("value") * F.col("n_test")).alias("s2"))
    placed = running_sums(counts, ["column"], ["value"],
                          {"c1": F.col("n_train"), "c2": F.col("n_test")})
    gap = F.abs(F.try_divide(F.col("c1") + F.col("n_train"), "n")
                - F.try_divide(F.col("c2") + F.col("n_test"), "m"))
    stats = (placed.join(F.broadcast(totals), "column")
             .groupBy("column", "n", "m", "s1", "s2").agg(F.max(gap).alias("d")))
    enough = (F.col("n") >= 5) & (F.col("m") >= 5)
    p = ks_pvalue(F.col("d"), F.col("n"), F.col("m"))
    score = F.least(F.lit(100.0), F.round(F.col("d") * 100 + F.when(p < 0.05, 20).otherwise(0), 1))
    listed = train.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return (listed.join(F.broadcast(stats), "column", "left").select(
        "column", F.when(enough, F.round("d", 4)).alias("ks_statistic"),
        F.when(enough, F.round(p, 4)).alias("ks_pvalue"),
        F.when(enough, F.round(F.col("s1") / F.col("n"), 4)).alias("train_mean"),
        F.when(enough, F.round(F.col("s2") / F.col("m"), 4)).alias("test_mean"),
        F.when(enough, score).otherwise(0.0).alias("drift_score")))


def category_counts(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n_train, n_test`` of the named columns as text."""
    return _both_sides(text_counts(train, columns), text_counts(test, columns))


def categorical_drift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, distribution_shift, new_category_count, drift_score``."""
    counts = category_counts(train, test, columns)
    totals = counts.groupBy("column").agg(F.sum("n_train").alias("n"), F.sum("n_test").alias("m"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    facts = (counts.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.sum(F.abs(share("n_train", "n") - share("n_test", "m"))).alias("shift"),
        F.count_if((F.col("n_train") == 0) & (F.col("n_test") > 0)).alias("new_category_count")))
    score = F.round(F.col("shift") * 50 + F.least(F.lit(40), F.col("new_category_count") * 10), 1)
    return facts.select("column", F.round("shift", 4).alias("distribution_shift"),
                        "new_category_count", F.least(F.lit(100.0), score).alias("drift_score"))


def new_categories(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value``: values of the test table the train table does not have."""
    seen = text_counts(train, columns).select("column", "value")
    return text_counts(test, columns).select("column", "value").join(seen, ["column", "value"],
                                                                     "left_anti")


def severity(score):
    return F.when(score > 50, "high").when(score > DRIFTED, "medium").otherwise("low")


def drift_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row per compared column, highest score first."""
    chosen = drift_columns(train, test)
    train, test = normalise(train), normalise(test)
    spark = train.sparkSession
    names = [c for c, _, _ in chosen]
    numeric = [c for c, k, s in chosen if k == "numeric" and s == "ok"]
    categorical = [c for c, k, _ in chosen if k == "categorical"]
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    num = numeric_drift(train, test, numeric) if numeric else nothing(
        "column string, ks_statistic double, ks_pvalue double, train_mean double, "
        "test_mean double, drift_score double")
    cat = categorical_drift(train, test, categorical) if categorical else nothing(
        "column string, distribution_shift double, new_category_count bigint, drift_score double")
    rates = missing_rates(train, test, names) if names else nothing(
        "column string, train_missing double, test_missing double, delta double")
    scores = num.unionByName(cat, allowMissingColumns=True)
    shift = F.when(F.col("train_mean") != 0, F.round(
        F.try_divide((F.col("test_mean") - F.col("train_mean")) * 100, F.abs("train_mean")), 2))
    return (spark.createDataFrame(chosen, "column string, kind string, status string")
            .join(F.broadcast(rates), "column", "left").join(F.broadcast(scores), "column", "left")
            .withColumn("mean_shift_pct", shift)
            .withColumn("severity", F.when(F.col("drift_score").isNotNull(),
                                           severity(F.col("drift_score"))))
            .select(*REPORT_SCHEMA).orderBy(F.desc_nulls_last("drift_score"), "column"))


def overall_drift(report: DataFrame) -> DataFrame:
    """``overall_drift_score``: mean of the scores, each weighted by itself plus one."""
    s = F.col("drift_score")
    mean = F.try_divide(F.sum(s * (s + 1)), F.sum(s + 1))
    return report.agg(F.coalesce(F.least(F.lit(100), F.bround(mean).cast("int")), F.lit(0))
                      .alias("overall_drift_score"))


def drift_summary(report: DataFrame) -> DataFrame:
    """One row of counts from the rows of ``drift_report``.

    ``drifted`` columns, ``new_values`` in ``columns_with_new`` columns, columns
    whose null rate moved by over 0.01 and over 0.1, and whether all is quiet.
    """
    found = report.agg(
        F.count_if(F.col("drift_score") > DRIFTED).alias("drifted"),
        F.coalesce(F.sum("new_category_count"), F.lit(0)).alias("new_values"),
        F.count_if(F.col("new_category_count") > 0).alias("columns_with_new"),
        F.count_if(F.abs("delta") > 0.01).alias("nulls_moved"),
        F.count_if(F.abs("delta") > 0.1).alias("nulls_moved_far"))
    return found.withColumn("quiet", (F.col("drifted") == 0) & (F.col("new_values") == 0) & (F.col("nulls_moved") == 0))
