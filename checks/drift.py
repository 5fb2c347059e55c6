"""Train/test drift."""

from pyspark.sql import functions as F

from checks.registry import on, query, union
from plumbline.functions.columns import rounded
from plumbline.operators import drift

# columns of the fixture with train distinct / rows under 0.95
NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_orderkey"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
ALL = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_orderkey"]
SIDES = ("drift_train", "drift_test")

RATES = "rates AS (" + union("""
SELECT '@n' AS col, (SELECT avg((@c IS NULL)::INT) FROM drift_train) AS train_missing,
  (SELECT avg((@c IS NULL)::INT) FROM drift_test) AS test_missing""", ALL) + ")"

KS = "ks AS (" + union("""
SELECT '@n' AS col, (SELECT count(@c) FROM drift_train) AS n, (SELECT count(@c) FROM drift_test) AS m,
  (SELECT avg(@c) FROM drift_train) AS m1, (SELECT avg(@c) FROM drift_test) AS m2, max(abs(f1 - f2)) AS d
FROM (SELECT sum(a) OVER w / (SELECT count(@c) FROM drift_train) AS f1, sum(b) OVER w / (SELECT count(@c) FROM drift_test) AS f2
  FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT @c::DOUBLE AS v, 1 AS a, 0 AS b FROM drift_train UNION ALL
        SELECT @c::DOUBLE, 0, 1 FROM drift_test) WHERE v IS NOT NULL GROUP BY v)
  WINDOW w AS (ORDER BY v))""", NUMERIC) + """),
kp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS p
  FROM (SELECT *, d * sqrt((n::DOUBLE * m) / (n + m)) AS lam FROM ks)),
num AS (SELECT *, least(100.0, round(d * 100 + CASE WHEN p < 0.05 THEN 20 ELSE 0 END, 1)) AS score FROM kp)"""

CAT = "cat AS (" + union("""
SELECT '@n' AS col, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS shift, count(*) FILTER (a.p IS NULL) AS fresh
FROM (SELECT @c AS v, count(*) / (SELECT count(@c) FROM drift_train) AS p FROM drift_train WHERE @c IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT @c AS v, count(*) / (SELECT count(@c) FROM drift_test) AS p FROM drift_test WHERE @c IS NOT NULL GROUP BY 1) b
ON a.v = b.v""", CATEGORICAL) + """),
scored AS (SELECT *, least(100.0, round(shift * 50 + least(40, fresh * 10), 1)) AS score FROM cat)"""

REPORT = f"""{RATES}, {KS}, {CAT},
rep AS (SELECT r.col AS "column", CASE WHEN n.col IS NULL THEN 'categorical' ELSE 'numeric' END AS kind,
  round(train_missing, 4) AS train_missing, round(test_missing, 4) AS test_missing,
  round(test_missing - train_missing, 4) AS delta, round(d, 4) AS ks_statistic, round(p, 4) AS ks_pvalue,
  round(m1, 4) AS train_mean, round(m2, 4) AS test_mean,
  CASE WHEN m1 <> 0 THEN round((round(m2, 4) - round(m1, 4)) * 100 / abs(round(m1, 4)), 2) END AS mean_shift_pct,
  round(shift, 4) AS distribution_shift, fresh AS new_category_count, coalesce(n.score, c.score) AS drift_score,
  CASE WHEN coalesce(n.score, c.score) > 50 THEN 'high' WHEN coalesce(n.score, c.score) > 25 THEN 'medium' ELSE 'low' END
    AS severity, 'ok' AS status
  FROM rates r LEFT JOIN num n ON r.col = n.col LEFT JOIN scored c ON r.col = c.col)"""


@query("i1_drift_columns", on(*SIDES, more="k AS (" + union(
    "SELECT '@n' AS col, count(DISTINCT @c) / count(*) AS r FROM drift_train", ALL) + ")", body=f"""
SELECT col AS "column", CASE WHEN col IN {tuple(CATEGORICAL)} THEN 'categorical' ELSE 'numeric' END AS kind,
  'ok' AS status FROM k WHERE r < 0.95"""))
def i1(t):
    return t.spark.createDataFrame(drift.drift_columns(t(SIDES[0]), t(SIDES[1])),
                                   "column string, kind string, status string")


@query("i2_missing_rate_delta", on(*SIDES, more=RATES, body="""
SELECT col AS "column", round(test_missing - train_missing, 4) AS delta FROM rates
WHERE abs(test_missing - train_missing) > 0.01"""))
def i2(t):
    return drift.missing_rate_delta(t(SIDES[0]), t(SIDES[1]), ALL)


@query("i3_numeric_drift", on(*SIDES, more=KS, body="""
SELECT col AS "column", round(d, 4) AS ks_statistic, round(p, 4) AS ks_pvalue, round(m1, 4) AS train_mean,
  round(m2, 4) AS test_mean, score AS drift_score FROM num"""))
def i3(t):
    return drift.numeric_drift(t(SIDES[0]), t(SIDES[1]), NUMERIC)


@query("i4_ks_pvalue", on("orders_labeled", more="""
ks AS (SELECT o_orderstatus AS "column", n, m, max(abs(f1 - f2)) AS d FROM (
  SELECT o_orderstatus, n, m, sum(a) OVER w / n AS f1, sum(b) OVER w / m AS f2 FROM (
    SELECT o_orderstatus, o_totalprice AS v, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b,
      sum(a) OVER (PARTITION BY o_orderstatus) AS n, sum(b) OVER (PARTITION BY o_orderstatus) AS m
    FROM orders_labeled GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY v)) GROUP BY ALL),
l AS (SELECT *, d * sqrt((n::DOUBLE * m) / (n + m)) AS lam FROM ks)""", body="""
SELECT "column", round(d, 4) AS ks_statistic, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)
  * exp(-2.0 * k * k * lam * lam))))) END, 4) AS ks_pvalue FROM l"""))
def i4(t):
    # odd against even order keys inside each status: samples that do not drift
    from plumbline.functions.columns import union_all
    orders = t("orders_labeled").withColumn("odd", F.col("o_orderkey") % 2)
    wide = [orders.filter(F.col("odd") == k).select(*[
        F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).alias(s) for s in "FOP"]) for k in (0, 1)]
    return drift.numeric_drift(wide[0], wide[1], list("FOP")).select("column", "ks_statistic", "ks_pvalue")


@query("i6_categorical_drift", on(*SIDES, more=CAT, body="""
SELECT col AS "column", round(shift, 4) AS distribution_shift, fresh AS new_category_count, score AS drift_score
FROM scored"""))
def i6(t):
    return drift.categorical_drift(t(SIDES[0]), t(SIDES[1]), CATEGORICAL)


@query("i7_new_categories", on(*SIDES, body=union("""
SELECT '@n' AS "column", v AS value FROM (SELECT DISTINCT @c AS v FROM drift_test WHERE @c IS NOT NULL
EXCEPT SELECT DISTINCT @c FROM drift_train)""", CATEGORICAL)))
def i7(t):
    return drift.new_categories(t(SIDES[0]), t(SIDES[1]), CATEGORICAL)


@query("i8_drift_report", on(*SIDES, more=REPORT, body="SELECT * FROM rep"))
def i8(t):
    return rounded(drift.drift_report(t(SIDES[0]), t(SIDES[1])), "train_missing", "test_missing", "delta")


@query("i9_overall_drift", on(*SIDES, more=REPORT, body="""
SELECT least(100, round_even(sum(drift_score * (drift_score + 1)) / sum(drift_score + 1), 0))::INT AS overall_drift_score
FROM rep"""))
def i9(t):
    return drift.overall_drift(drift.drift_report(t(SIDES[0]), t(SIDES[1])))


@query("i10_drift_summary", on(*SIDES, more=REPORT, body="""
SELECT count(*) FILTER (drift_score > 25) AS drifted, coalesce(sum(new_category_count), 0)::BIGINT AS new_values,
  count(*) FILTER (new_category_count > 0) AS columns_with_new, count(*) FILTER (abs(delta) > 0.01) AS nulls_moved,
  count(*) FILTER (abs(delta) > 0.1) AS nulls_moved_far,
  count(*) FILTER (drift_score > 25) = 0 AND coalesce(sum(new_category_count), 0) = 0
    AND count(*) FILTER (abs(delta) > 0.01) = 0 AS quiet
FROM rep"""))
def i10(t):
    return drift.drift_summary(drift.drift_report(t(SIDES[0]), t(SIDES[1])))


@query("i11_mean_shift_severity", on(*SIDES, more=REPORT, body="""
SELECT "column", drift_score, mean_shift_pct, severity FROM rep ORDER BY drift_score DESC"""))
def i11(t):
    return drift.drift_report(t(SIDES[0]), t(SIDES[1])).select("column", "drift_score", "mean_shift_pct", "severity")
