"""ML readiness."""

from pyspark.sql import functions as F

from checks.association import IMPACT
from checks.columns import TYPES, views_sql
from checks.registry import on, query, union
from plumbline.functions.columns import rounded
from plumbline.ml import features as ft
from plumbline.ml import readiness as rd
from plumbline.ml import supervised as sv
from plumbline.ml import unsupervised as us
from plumbline.operators.profile import Profile
from plumbline.plans.full_report import full_report
from plumbline.series import report  # noqa: F401


def labeled(t, target="big_order"):
    """The labeled fixture without the planted copies of the target."""
    return t("orders_labeled").drop(*[c for c in ("leak", "price_band", "big_order") if c != target])


# ---- health, duplicates, scores ----

def health_sql(table):
    shape = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS col, {i} AS pos, count(DISTINCT "{c}") AS nd, 1 - count("{c}") / count(*) AS nulls, count(*) AS n FROM {table}"""
        for i, c in enumerate(TYPES[table]))
    return views_sql(table, f"""
SELECT (CASE WHEN u = 0 THEN 0 ELSE 100 END - CASE WHEN n < 5 * u THEN 40 ELSE 0 END - CASE WHEN u < 3 THEN 30 ELSE 0 END
  - CASE WHEN u > n THEN 30 ELSE 0 END - CASE WHEN k <> '' THEN 10 ELSE 0 END - CASE WHEN m <> '' THEN 20 ELSE 0 END)::INT
    AS health_score, u::INT AS usable_features, k AS constant_columns, m AS high_missing_columns
FROM (SELECT (SELECT count(*) FROM views WHERE view IN ('numeric', 'categorical')) AS u, max(n) AS n,
    coalesce(string_agg(CASE WHEN nd <= 1 THEN col END, ',' ORDER BY pos), '') AS k,
    coalesce(string_agg(CASE WHEN nulls > 0.5 THEN col END, ',' ORDER BY pos), '') AS m FROM ({shape}))""")


TYPES["li_redundant"] = dict.fromkeys(["l_orderkey", "l_linenumber", "l_quantity", "l_qty_x2", "l_discount", "l_tax",
                                       "c_const", "c_mostly_zero"], "n")
for _table in ("li_redundant", "pages_text", "nation", "li_gappy"):
    query(f"k1_health_checks_{_table}", health_sql(_table))(
        lambda t, table=_table: rd.health_checks(Profile(t(table)), rd.Findings()))


@query("k2_leakage_checks", on("orders_labeled", more="num AS (" + union(
    "SELECT '@n' AS col, abs(corr(@c, big_order)) AS r FROM orders_labeled", ["o_custkey", "c_acctbal", "leak"])
    + "), cat AS (" + union(IMPACT.format(table="orders_labeled", y="big_order").replace("'@n' AS \"column\"", "'@n' AS col"),
                            ["c_mktsegment", "c_nationkey", "o_orderpriority", "o_orderstatus", "price_band"])
    + """), dup AS (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (big_order) FROM orders_labeled)) / count(*) AS d
  FROM orders_labeled)""", body="""
SELECT least(100, 40 * (SELECT count(*) FROM num WHERE r > 0.95) + 25 * (SELECT count(*) FROM cat WHERE shift_tv > 0.99)
    + CASE WHEN d > 0.2 THEN 25 WHEN d > 0.1 THEN 10 ELSE 0 END)::INT AS leakage_risk, round(d, 4) AS duplicate_share,
  (SELECT string_agg(col, ',' ORDER BY col) FROM (SELECT col FROM num WHERE r > 0.95 UNION SELECT col FROM cat WHERE shift_tv > 0.99
    UNION SELECT 'o_orderkey' UNION SELECT 'o_totalprice')) AS suspicious FROM dup"""))
def k2(t):
    p = Profile(t("orders_labeled"), "big_order")
    return rounded(rd.leakage_checks(p, rd.Findings()), "duplicate_share")


DUP = """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {table})) AS n_repeats,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {table}))) / count(*), 6) AS duplicate_share FROM {table}"""


@query("k3_duplicate_rows", on("li_gappy", body=DUP.format(
    table="li_gappy", cols="l_quantity, l_discount, l_returnflag")))
def k3(t):
    return rounded(ft.duplicate_rows(t("li_gappy").select("l_quantity", "l_discount", "l_returnflag", "l_tax"), ["l_tax"]),
                   "duplicate_share", digits=6)


@query("k3_duplicate_rows_conversations", DUP.format(table="conversations", cols="role, text"))
def k3_text(t):
    return rounded(ft.duplicate_rows(t("conversations"), ["conv_id", "turn"]), "duplicate_share", digits=6)


# ---- features ----

@query("k4_prepare_features", on("li_gappy", body="""
SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber,
  coalesce(l_quantity, (SELECT median(l_quantity) FROM li_gappy)) AS l_quantity,
  round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM li_gappy)), 4) AS l_extendedprice,
  coalesce(l_discount, (SELECT median(l_discount) FROM li_gappy)) AS l_discount, l_tax,
  (dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'NA')) - 1)::DOUBLE AS l_returnflag,
  (dense_rank() OVER (ORDER BY l_linestatus) - 1)::DOUBLE AS l_linestatus FROM li_gappy"""))
def k4(t):
    p = Profile(t("li_gappy"))
    enc = ft.encoder_for(p).fit(p.df, p.n_rows)
    return rounded(enc.transform(p.df.select(*p.features)), "l_extendedprice")


@query("k5_encode_target", on("orders_labeled", body="""
SELECT o_orderstatus AS label, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code, count(*) AS n
FROM orders_labeled GROUP BY 1"""))
def k5(t):
    return ft.encode_target(t("orders_labeled"), "o_orderstatus")


@query("k6_stratified_folds", on("orders_labeled", body="""
SELECT o_orderstatus, (i % 3)::INT AS fold, count(*) AS n
FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus) AS i FROM orders_labeled) GROUP BY ALL"""))
def k6(t):
    rows = t("orders_labeled").withColumn(ft.ROW, F.col("o_orderkey"))
    return ft.assign_folds(rows, 3, "o_orderstatus").groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@query("k10_eval_metrics", on("orders_labeled", more="""
pr AS (SELECT o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'P' WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS c,
  o_totalprice * 0.9 + o_custkey AS p FROM orders_labeled)""", body="""
SELECT (SELECT round(avg(r), 6) FROM (SELECT avg((c = o_orderstatus)::INT) AS r FROM pr GROUP BY o_orderstatus)) AS balanced_accuracy,
  round(1 - sum((o_totalprice - p) ** 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2,
  round(sqrt(avg((o_totalprice - p) ** 2)), 4) AS rmse FROM pr"""))
def k10(t):
    pr = t("orders_labeled").selectExpr(
        "o_orderstatus", "o_totalprice",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'P' WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS c",
        "o_totalprice * 0.9D + o_custkey AS p")
    acc = sv.balanced_accuracy(pr, "o_orderstatus", "c")
    reg = sv.regression_metrics(pr, "o_totalprice", "p")
    return reg.select(F.round(acc.scalar(), 6).alias("balanced_accuracy"), F.round("r2", 6).alias("r2"),
                      F.round("rmse", 4).alias("rmse"))


@query("k12_readiness_scores")
def k12(t):
    p, found = Profile(t("orders_labeled"), "big_order"), rd.Findings()
    rd.health_checks(p, found)
    rd.trainability_checks(p, found)
    rd.leakage_checks(p, found)
    return found.scores(t.spark)


@query("k13_findings")
def k13(t):
    p, found = Profile(t("orders_labeled"), "big_order"), rd.Findings()
    rd.health_checks(p, found)
    rd.leakage_checks(p, found)
    return found.table(t.spark)


@query("k14_unlabeled_guards", """
SELECT CASE WHEN (SELECT count(*) FROM nation) < 200 THEN 75 ELSE 100 END::INT AS trainability, true AS usable""")
def k14(t):
    found = rd.Findings()
    usable = rd.unlabeled_guards(Profile(t("nation")), found)
    return t.spark.createDataFrame([(found.trainability, usable)], "trainability int, usable boolean")


@query("k15_top_variance_columns", "SELECT * FROM (" + union(
    "SELECT '@n' AS \"column\", round(var_samp(@c), 3) AS variance FROM lineitem",
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]) + ") ORDER BY variance DESC LIMIT 3")
def k15(t):
    return rounded(ft.top_variance_columns(
        t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], 3), "variance", digits=3)


@query("k16_standard_scale", on("li_redundant", body="""
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  0.0::DOUBLE AS c_const FROM li_redundant"""))
def k16(t):
    out = ft.standard_scale(t("li_redundant"), ["l_quantity", "c_const"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "c_const"), "l_quantity", "c_const", digits=6)


@query("k17_binary_ratio", on("orders_labeled", body="SELECT round(avg((d <= 2)::INT), 6) AS binary_ratio FROM (" + union(
    "SELECT count(DISTINCT @c) AS d FROM orders_labeled",
    ["o_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", "o_orderpriority", "o_orderstatus", "big_order", "leak",
     "price_band"]) + ")"))
def k17(t):
    ratio = rd.binary_ratio(Profile(t("orders_labeled")))
    return t.spark.createDataFrame([(round(ratio, 6),)], "binary_ratio double")


# ---- fits ----

@query("k7_baseline_probe")
def k7(t):
    p = Profile(labeled(t), "big_order")
    return sv.baseline_probe(p, "classification", rd.Findings())["folds"]


@query("k7_baseline_probe_regression")
def k7_regression(t):
    p = Profile(labeled(t, "o_totalprice"), "o_totalprice")
    return sv.baseline_probe(p, "regression", rd.Findings())["curves"]


@query("k8_learning_dynamics")
def k8(t):
    p = Profile(labeled(t), "big_order")
    return sv.baseline_probe(p, "classification", rd.Findings())["dynamics"]


@query("k9_stability_checks")
def k9(t):
    p = Profile(labeled(t), "big_order")
    return sv.stability_checks(p, "classification", rd.Findings())["summary"]


@query("k11_labeled_diagnostics")
def k11(t):
    found = sv.labeled_diagnostics(Profile(labeled(t), "big_order"))
    return found["scores"]


@query("k11_leakage_stop", on("orders_labeled", more="num AS (" + union(
    "SELECT '@n' AS col, abs(corr(@c, big_order)) AS r FROM orders_labeled", ["o_custkey", "c_acctbal", "leak"])
    + "), cat AS (" + union(IMPACT.format(table="orders_labeled", y="big_order").replace("'@n' AS \"column\"", "'@n' AS col"),
                            ["c_mktsegment", "c_nationkey", "o_orderpriority", "o_orderstatus", "price_band"])
    + ")", body="""
SELECT CASE WHEN risk > 90 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN risk > 90 THEN 'leakage' END AS stage,
  CASE WHEN risk > 90 THEN 'leakage_risk' END AS issue, risk AS leakage_risk
FROM (SELECT least(100, 40 * (SELECT sum(CASE WHEN col = 'leak' THEN 3 ELSE 1 END) FROM num WHERE r > 0.95)
  + 25 * (SELECT count(*) FROM cat WHERE shift_tv > 0.99))::INT AS risk)"""))
def k11_stop(t):
    thrice = t("orders_labeled").withColumns({"leak_again": F.col("leak") * 2 + 1, "leak_once_more": F.col("leak") * 3 - 1})
    found = sv.labeled_diagnostics(Profile(thrice, "big_order"))
    return found["status"].withColumn("leakage_risk", F.lit(found["leakage"].first()["leakage_risk"]))


@query("k18_isolation_forest")
def k18(t):
    scaled, columns = us.unlabeled_features(Profile(t("li_gappy")))
    return us.isolation_scores(scaled, columns, [ft.ROW]).select(F.col(ft.ROW).alias("row"), "score", "is_anomaly")


@query("k18_anomaly_summary")
def k18_summary(t):
    scaled, columns = us.unlabeled_features(Profile(t("orders_labeled")))
    return us.anomaly_summary(us.isolation_scores(scaled, columns, [ft.ROW]))


@query("k18_score_distribution", """
WITH s AS (SELECT l_extendedprice / 120000.0 - 0.4 AS score FROM lineitem),
  k AS (SELECT greatest(0, least(49, floor((score + 0.5) * 50)))::INT AS bin, count(*) AS n FROM s WHERE score IS NOT NULL GROUP BY 1)
SELECT b.bin::INT AS bin, b.bin / 50.0 - 0.5 AS bin_start, coalesce(n, 0) AS n FROM range(50) b(bin) LEFT JOIN k ON k.bin = b.bin""")
def k18_distribution(t):
    """Parts of given scores."""
    return us.score_distribution(t("lineitem").select((F.col("l_extendedprice") / 120000.0 - 0.4).alias("score")))


@query("k19_clustering_diagnostics")
def k19(t):
    scaled, columns = us.unlabeled_features(Profile(t("orders_labeled")))
    return us.clustering_diagnostics(ft.with_vector(scaled, columns))


@query("k20_unlabeled_stability")
def k20(t):
    scaled, columns = us.unlabeled_features(Profile(t("orders_labeled")))
    return us.unlabeled_stability(ft.with_vector(scaled, columns))


@query("k21_model_arena")
def k21(t):
    p = Profile(labeled(t), "big_order")
    return sv.model_arena(p, "classification")


@query("k22_arena_ranking_regression")
def k22(t):
    p = Profile(labeled(t, "o_totalprice"), "o_totalprice")
    return sv.arena_ranking(sv.model_arena(p, "regression"))


@query("m4_full_report_labeled")
def m4(t):
    return full_report(t("orders_labeled").drop("price_band", "leak"), "big_order").evaluate().status


@query("m4_full_report_labeled_planted")
def m4_planted(t):
    return full_report(t("orders_labeled"), "big_order", row_key="o_orderkey").evaluate().status


@query("m4_full_report_unlabeled")
def m4_unlabeled(t):
    return full_report(t("li_gappy")).evaluate().status
