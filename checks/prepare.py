"""Sources, sinks and preprocessing."""

from pyspark.sql import functions as F

from checks.patterns import LINK, MAIL, SPACE, SPECIAL, TAG
from checks.registry import on, query
from plumbline.functions.columns import rounded
from plumbline.functions.session import scratch_path
from plumbline.functions.words import STOP_WORDS
from plumbline.operators.profile import Profile
from plumbline.plans import preprocess as pp
from plumbline.plans import text_features as tf
from plumbline.plans.full_report import choose_pipeline
from plumbline.sources import sink, tables

STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + ")"


@query("a1_scan_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || chr(10) || 'a "b", c' END AS o_orderpriority
FROM orders""")
def a1(t):
    """Absent values as tokens, line breaks and quotes inside quotes, types found by the reader."""
    path = scratch_path(t.spark, "orders-csv")
    absent = F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string"))
    noted = F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise(F.concat("o_orderpriority", F.lit('\na "b", c')))
    t("orders").withColumns({"o_totalprice": absent, "o_orderpriority": noted}) \
        .write.options(header=True, escape='"').csv(path)
    return tables.read_csv(t.spark, path).withColumns({
        c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


@query("a2_scan_parquet", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_shipdate >= timestamp '1998-07-01 00:00:00' GROUP BY l_returnflag""")
def a2(t):
    items = tables.read_parquet(t.spark, f"{t.folder}/lineitem.parquet",
                                ["l_returnflag", "l_quantity", "l_shipdate"])
    return (items.filter("l_shipdate >= timestamp '1998-07-01 00:00:00'").groupBy("l_returnflag")
            .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))


@query("a4_write_report", """
SELECT o_orderstatus, count(*) AS n, NULL::DOUBLE AS not_a_number, NULL::DOUBLE AS endless FROM orders GROUP BY 1""")
def a4(t):
    folder = scratch_path(t.spark, "report")
    result = t("orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.lit(float("nan")).alias("not_a_number"), F.lit(float("inf")).alias("endless"))
    sink.write_report({"status": result}, folder)
    return t.spark.read.schema(result.schema).json(f"{folder}/status")


@query("a6_sample_rows")
def a6(t):
    from plumbline.ml.features import ROW, subsample
    rows = t("orders").withColumn(ROW, F.col("o_orderkey"))
    return subsample(rows, 1).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


# ---- preprocessing ----

PAIRS = "\nUNION ALL\n".join(f"""
SELECT '{a}' AS "column", CASE WHEN stddev_samp("{a}") > 0 AND stddev_samp("{b}") > 0 THEN abs(corr("{a}", "{b}")) END AS v
FROM li_redundant""" for a, b in [("l_quantity", "l_qty_x2"), ("l_quantity", "l_discount"), ("l_discount", "l_tax"),
                                  ("l_linenumber", "l_quantity"), ("l_quantity", "c_mostly_zero")])


@query("l1_drop_columns", on("li_redundant", more=f"p AS ({PAIRS})", body="""
SELECT 'c_const' AS "column", 'constant' AS reason FROM li_redundant HAVING count(DISTINCT c_const) <= 1
UNION ALL SELECT 'c_mostly_zero', 'mostly_zero' FROM li_redundant
  HAVING count(*) FILTER (c_mostly_zero = 0) / count(*) > 0.95 AND count(DISTINCT c_mostly_zero) > 2
UNION ALL SELECT DISTINCT "column", 'redundant' FROM p WHERE v > 0.98"""))
def l1(t):
    return pp.columns_to_drop(Profile(t("li_redundant")))


KEYS = ["l_orderkey", "l_linenumber"]


@query("l2_impute_median", on("li_gappy", body="""
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM li_gappy)) AS l_quantity,
  round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM li_gappy)), 4) AS l_extendedprice,
  coalesce(l_discount, (SELECT median(l_discount) FROM li_gappy)) AS l_discount FROM li_gappy"""))
def l2(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(pp.impute_median(t("li_gappy"), cols).select(*KEYS, *cols), "l_extendedprice")


@query("l3_impute_mode", on("li_gappy", body="""
SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT l_returnflag FROM li_gappy WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM li_gappy"""))
def l3(t):
    return pp.impute_mode(t("li_gappy"), ["l_returnflag"]).select(*KEYS, "l_returnflag")


@query("l4_log_transform", """
SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 8) AS l_extendedprice, l_discount FROM lineitem""")
def l4(t):
    # l_discount holds zeros and stays as it is
    out = pp.log_transform(t("lineitem"), ["l_extendedprice", "l_discount"])
    return rounded(out.select(*KEYS, "l_extendedprice", "l_discount"), "l_extendedprice", digits=8)


@query("l5_log1p_transform", """
SELECT event_id, round(ln(1 + value), 8) AS value FROM events""")
def l5(t):
    return rounded(pp.log1p_transform(t("events"), ["value"]).select("event_id", "value"), "value", digits=8)


@query("l6_label_encode", on("li_gappy", body="""
SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'MISSING')) - 1 AS l_returnflag,
  dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM li_gappy"""))
def l6(t):
    return pp.label_encode(t("li_gappy"), ["l_returnflag", "l_linestatus"]).select(*KEYS, "l_returnflag", "l_linestatus")


@query("l7_target_mean_encode", on("orders_labeled", body="""
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY c_nationkey), 4) AS c_nationkey FROM orders_labeled"""))
def l7(t):
    out = pp.target_mean_encode(t("orders_labeled"), ["c_nationkey"], "o_totalprice")
    return rounded(out.select("o_orderkey", "c_nationkey"), "c_nationkey")


def clean_sql(c):
    for pattern in (TAG, LINK, MAIL, SPECIAL, r"\p{Nd}+"):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    trim = f"regexp_replace(lower({c}), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    return f"regexp_replace({trim}, '[{SPACE}]+', ' ', 'g')"


@query("l8_clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def l8(t):
    return t("documents").select("doc_id", tf.clean_text(F.col("text")).alias("text"))


@query("l8_clean_text_pages", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def l8_pages(t):
    return t("pages").select("page_id", tf.clean_text(F.col("html")).alias("text"))


KEPT = f"list_filter(string_split({clean_sql('text')}, ' '), lambda w: length(w) > 2 AND w NOT IN {STOPS})"


@query("l9_filter_tokens", f"SELECT doc_id, array_to_string({KEPT}, ' ') AS text FROM documents")
def l9(t):
    return t("documents").select("doc_id", tf.filter_tokens(tf.clean_text(F.col("text"))).alias("text"))


TFIDF = """
tok AS (SELECT doc_id, @kept AS w FROM docs_labeled),
terms AS (SELECT doc_id, unnest(w) AS term FROM tok UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok WHERE len(w) >= 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
voc AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term @limit),
num AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM voc),
w AS (SELECT doc_id, term, idx, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs_labeled)) / (1 + df)) + 1) AS w
  FROM tf JOIN num USING (term)),
weights AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)""".replace("@kept", KEPT)
ALL_TERMS, TOP_TERMS = TFIDF.replace("@limit", ""), TFIDF.replace("@limit", "LIMIT 5000")


@query("l10_tfidf_features", on("docs_labeled", more=TOP_TERMS, body="""
SELECT doc_id, term, idx AS "index", round(weight, 8) AS weight FROM weights"""))
def l10(t):
    return rounded(tf.tfidf_features(t("docs_labeled"), "doc_id", "text"), "weight", digits=8)


@query("l10_tfidf_features_all_terms", on("docs_labeled", more=ALL_TERMS, body="""
SELECT doc_id, term, idx AS "index", round(weight, 8) AS weight FROM weights"""))
def l10_all(t):
    return rounded(tf.tfidf_features(t("docs_labeled"), "doc_id", "text", max_terms=None), "weight", digits=8)


@query("l11_assemble_features", on("docs_labeled", more=TOP_TERMS, body="""
SELECT doc_id, idx AS "index", round(weight, 8) AS value FROM weights
UNION ALL SELECT doc_id, 5000, n_chars::DOUBLE FROM docs_labeled WHERE n_chars <> 0
UNION ALL SELECT doc_id, 5001, toxic::DOUBLE FROM docs_labeled WHERE toxic <> 0"""))
def l11(t):
    return rounded(tf.assemble_features(t("docs_labeled"), "doc_id", "text", ["n_chars", "toxic"]), "value", digits=8)


@query("l12_preprocess_plan")
def l12(t):
    p = Profile(t("li_gappy"))
    return pp.PreprocessPlan.fit(p).transform(p.df)


@query("l12_choose_pipeline", """
SELECT 'orders' AS tab, 'timeseries' AS pipeline UNION ALL SELECT 'documents', 'text' UNION ALL SELECT 'nation', 'tabular'""")
def l12_choice(t):
    rows = [(n, choose_pipeline(t(n))) for n in ("orders", "documents", "nation")]
    return t.spark.createDataFrame(rows, "tab string, pipeline string")
