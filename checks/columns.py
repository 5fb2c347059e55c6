"""Column profile, missing values, numeric and categorical summaries."""

from checks.registry import FIXTURES, on, query, union
from plumbline.functions.columns import rounded
from plumbline.operators import categorical, missing, numeric, profile
from plumbline.operators.profile import Profile

LINEITEM = ["l_quantity", "l_discount", "l_tax"]
GAPPY_NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY_CATEGORICAL = ["l_orderkey", "l_returnflag", "l_linestatus"]
GAPPY = GAPPY_NUMERIC + GAPPY_CATEGORICAL
REDUNDANT = ["l_linenumber", "l_quantity", "l_qty_x2", "l_discount", "l_tax", "c_const",
             "c_mostly_zero"]

TYPES = {
    "region": dict(r_regionkey="n", r_name="s"),
    "nation": dict(n_nationkey="n", n_name="s", n_regionkey="n"),
    "customer": dict(c_custkey="n", c_name="s", c_nationkey="n", c_acctbal="n", c_mktsegment="s"),
    "supplier": dict(s_suppkey="n", s_name="s", s_nationkey="n", s_acctbal="n"),
    "part": dict(p_partkey="n", p_name="s", p_brand="s", p_type="s", p_size="n", p_retailprice="n"),
    "orders": dict(o_orderkey="n", o_custkey="n", o_orderstatus="s", o_totalprice="n",
                   o_orderdate="t", o_orderpriority="s"),
    "lineitem": dict(l_orderkey="n", l_partkey="n", l_suppkey="n", l_linenumber="n", l_quantity="n",
                     l_extendedprice="n", l_discount="n", l_tax="n", l_returnflag="s",
                     l_linestatus="s", l_shipdate="t"),
    "events": dict(event_id="n", ts="t", user_id="n", event_type="s", value="n", props="s"),
    "documents": dict(doc_id="n", text="s", lang="s", source="s", n_chars="n"),
    "labels": dict(doc_id="n", quality="n", toxic="n"),
    "pages": dict(page_id="n", url="s", html="s"),
    "benchmark": dict(item_id="n", text="s"),
    "conversations": dict(conv_id="n", turn="n", role="s", text="s"),
    "embeddings": dict(vec_id="n", embedding="u", label="n"),
    "li_gappy": dict(l_orderkey="n", l_linenumber="n", l_quantity="n", l_extendedprice="n",
                     l_discount="n", l_tax="n", l_returnflag="s", l_linestatus="s"),
    "orders_labeled": dict(o_orderkey="n", o_custkey="n", c_mktsegment="s", c_nationkey="n",
                           c_acctbal="n", o_orderpriority="s", o_totalprice="n", o_orderstatus="s",
                           big_order="n", leak="n", price_band="s"),
    "docs_labeled": dict(doc_id="n", text="s", lang="s", source="s", n_chars="n", quality="n",
                         toxic="n"),
    "pages_text": dict(page_id="n", grp="n", text="s", maybe_url="s"),
    "customer_shapes": {"c_custkey": "n", "c_mktsegment": "s", "c_acctbal": "n", "c_address": "s",
                        "c_coord": "s", "c_grp60": "n", "zipcode": "n", "region code": "n"},
}

# Name parts of identifier columns.
SEGMENTS = ("['id','key','code','num','no','number','postal','permit','fips','idx','seq','ref',"
            "'oid']")
NAMES = ("('uuid','guid','zipcode','postcode','fips','oid','uid','nid','pid','rid','sid','cid')")


def sql_text(name: str, kind: str) -> str:
    if kind == "t":
        return f"regexp_replace(strftime(\"{name}\", '%Y-%m-%d %H:%M:%S'), ' 00:00:00$', '')"
    return f'"{name}"'


def facts_sql(table: str) -> str:
    """One row of role facts per column of the table."""
    rows = []
    for name, kind in TYPES[table].items():
        if kind == "u":
            continue
        c = f'"{name}"'
        head = (f"SELECT '{name}' AS col, '{kind}' AS kind, count(DISTINCT {c}) AS nd, "
                f"count(DISTINCT {c}) / count(*) AS ratio, count({c}) AS n, ")
        if kind == "n":
            rows.append(head + f"""
  coalesce(bool_and({c} = floor({c})), true) AS integral, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
  quantile_cont(CASE WHEN {c} <> 0 THEN {c}::DOUBLE END, 0.05) AS p5,
  0.0::DOUBLE AS words, 0.0::DOUBLE AS len, 0.0::DOUBLE AS wsd, 0.0::DOUBLE AS addr, 0.0::DOUBLE AS coord FROM {table}""")
        else:
            s = sql_text(name, kind)
            w = f"len(regexp_extract_all({s}, '\\S+'))"
            rows.append(head + f"""
  false AS integral, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS p5,
  avg({w}) AS words, avg(length({s})) AS len, stddev_samp({w}) AS wsd,
  avg(CASE WHEN regexp_matches({s}, '^\\d+\\s+\\w+') THEN 1 ELSE 0 END) AS addr,
  avg(CASE WHEN regexp_matches({s}, '^\\s*\\(?\\s*-?\\d+\\.\\d+\\s*,\\s*-?\\d+\\.\\d+') THEN 1 ELSE 0 END) AS coord
  FROM {table}""")
    return "\nUNION ALL\n".join(rows)


VIEWS = f"""
by_value AS (SELECT *, CASE
    WHEN ratio >= 0.96 THEN 'identifier:B4'
    WHEN kind = 'n' AND integral AND ratio > 0.5 THEN 'entity_key:B5'
    WHEN kind = 'n' AND integral AND p5 > 100 AND nd > 50 THEN 'categorical:B6'
    WHEN kind <> 'n' AND ratio > 0.02 AND ratio < 0.95 THEN CASE
      WHEN addr > 0.7 THEN 'entity_key:B7'
      WHEN words > 3 OR len > 20 OR (len > 15 AND ratio > 0.7) THEN
        CASE WHEN ratio > 0.8 AND words < 8 AND len < 50 AND wsd < 3 THEN 'entity_key:B8'
             ELSE 'free_text:B8' END
      ELSE 'entity_key:B8' END
    WHEN kind <> 'n' THEN 'categorical:default'
    WHEN integral AND nd <= 30 AND (n = 0 OR (lo >= 0 AND hi <= 10)) THEN 'numeric:B9'
    WHEN integral AND nd <= 30 THEN 'categorical:B9'
    ELSE 'numeric:default' END AS r FROM facts),
by_name AS (SELECT *, CASE
    WHEN r = 'free_text:B8' AND coord > 0.7 THEN 'identifier:B10'
    WHEN (r LIKE 'numeric:%' OR r LIKE 'categorical:%') AND (
      list_has_any(string_split(replace(replace(trim(lower(col)), '-', '_'), ' ', '_'), '_'), {SEGMENTS})
      OR trim(lower(col)) IN {NAMES}
      OR regexp_matches(col, '(_id|_Id|_ID|_idx|_Idx|_cd|_Cd)$')
      OR regexp_matches(trim(lower(col)), '(^|[-_ ])id$')) THEN 'identifier:B11'
    ELSE r END AS final FROM by_value),
views AS (SELECT col, split_part(final, ':', 1) AS view, split_part(final, ':', 2) AS rule, ratio, nd, p5,
  kind FROM by_name)"""


def views_sql(table: str, body: str) -> str:
    return on(table, more=f"facts AS ({facts_sql(table)}), {VIEWS}", body=body)


ALL_TABLES = [t for t in TYPES if t not in FIXTURES]


def all_views_sql(tables) -> str:
    fixtures = [t for t in tables if t in FIXTURES]
    parts = []
    for t in tables:
        extra = "".join(f" UNION ALL SELECT '{t}', '{c}', 'unsupported', 'type'"
                        for c, k in TYPES[t].items() if k == "u")
        parts.append(f"SELECT '{t}' AS tab, col AS \"column\", view, rule FROM (WITH facts AS "
                     f"({facts_sql(t)}), {VIEWS} SELECT * FROM views)" + extra)
    return on(*fixtures, body="\nUNION ALL\n".join(parts))


def _all_views(t, tables):
    from pyspark.sql import functions as F
    from plumbline.functions.columns import union_all
    return union_all([profile.column_views(Profile(t(n))).withColumn("tab", F.lit(n)) for n in tables])


@query("b1_basic_info", union(
    "SELECT '@n' AS \"column\", count(*) AS n_rows, count(DISTINCT @c) AS n_distinct FROM lineitem",
    list(TYPES["lineitem"])))
def b1(t):
    return profile.basic_info(t("lineitem"))


@query("b2_uniqueness_ratio", on("li_gappy", body=union(
    "SELECT '@n' AS \"column\", round(count(DISTINCT @c) / count(*), 6) AS ratio FROM li_gappy",
    list(TYPES["li_gappy"]))))
def b2(t):
    from plumbline.functions.columns import rounded
    return rounded(profile.uniqueness_ratio(t("li_gappy")), "ratio", digits=6)


@query("b3_integer_valued", union(
    "SELECT '@n' AS \"column\", bool_and(@c % 1 = 0) AS integer_valued FROM lineitem",
    [c for c, k in TYPES["lineitem"].items() if k == "n"]))
def b3(t):
    return profile.integer_valued(t("lineitem"))


def _rule_sql(table, rule, measured="NULL::DOUBLE"):
    return views_sql(table, f"""SELECT col AS "column", view, round(ratio, 6) AS ratio, nd AS n_distinct
FROM views WHERE rule = '{rule}'""")


def _rule(t, table, rule):
    from plumbline.functions.columns import rounded
    return rounded(profile.columns_by_rule(Profile(t(table)), rule).drop("p5_nonzero"), "ratio", digits=6)


for _name, _table, _rule_id in [
        ("b4_identifier_by_ratio", "orders", "B4"),
        ("b5_entity_key_numeric", "documents", "B5"),
        ("b6_code_like_numeric", "customer_shapes", "B6"),
        ("b7_address_like", "customer_shapes", "B7"),
        ("b9_low_card_encoded", "orders_labeled", "B9"),
        ("b10_coordinate_like", "customer_shapes", "B10"),
        ("b11_identifier_by_name", "customer_shapes", "B11")]:
    query(_name, _rule_sql(_table, _rule_id))(
        lambda t, table=_table, rule=_rule_id: _rule(t, table, rule))


@query("b8_string_shape", on("docs_labeled", more=f"facts AS ({facts_sql('docs_labeled')})", body="""
SELECT col AS "column", n, round(words, 4) AS words, round(len, 4) AS length, round(wsd, 4) AS words_std,
  round(addr, 4) AS address, round(coord, 4) AS coordinate FROM facts WHERE kind <> 'n'"""))
def b8(t):
    from plumbline.functions.columns import rounded
    return rounded(profile.string_shape(t("docs_labeled")), "words", "length", "words_std", "address",
                   "coordinate")


@query("b12_column_views", all_views_sql(ALL_TABLES))
def b12(t):
    return _all_views(t, ALL_TABLES)


DERIVED = ["li_gappy", "orders_labeled", "docs_labeled", "pages_text", "customer_shapes"]


@query("b12_column_views_derived", all_views_sql(DERIVED))
def b12_derived(t):
    return _all_views(t, DERIVED)


# ---- missing values ----

@query("c1_missing_by_column", on("li_gappy", body=union("""
SELECT '@n' AS "column", round(100.0 * count(*) FILTER (@c IS NULL) / count(*), 4) AS missing_pct,
  100.0 * count(*) FILTER (@c IS NULL) / count(*) > 30 AS flagged FROM li_gappy""", GAPPY)))
def c1(t):
    from plumbline.functions.columns import rounded
    return rounded(missing.missing_report(Profile(t("li_gappy")))["missing_by_column"], "missing_pct")


NULL_SUM = " + ".join(f'CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END' for c in GAPPY)
PCT = f"pct AS (SELECT l_orderkey, l_linenumber, 100.0 * ({NULL_SUM}) / {len(GAPPY)} AS p FROM li_gappy)"


@query("c2_missing_row_flags", on("li_gappy", more=PCT, body="\nUNION ALL\n".join(
    f"SELECT {x} AS threshold, count(*) FILTER (p > {x}) AS n_rows FROM pct" for x in (30, 50, 70))))
def c2(t):
    return missing.missing_report(Profile(t("li_gappy")))["missing_row_flags"]


@query("c3_severe_rows", on("li_gappy", more=PCT, body="""
SELECT l_orderkey, l_linenumber, round(p, 4) AS missing_pct FROM pct WHERE p > 30
ORDER BY l_orderkey, l_linenumber LIMIT 50"""))
def c3(t):
    from plumbline.functions.columns import rounded
    p = Profile(t("li_gappy"))
    keys = p.df.select("l_orderkey", "l_linenumber", "l_quantity")
    # no fixture row is over 70 percent, so the lowest threshold shows the operator at work
    return rounded(missing.severe_rows(p.df, p.features, keys.columns[:2], threshold=30), "missing_pct")


@query("c4_missing_row_distribution", on("li_gappy", more=PCT, body="""
SELECT b.bin_order, b.bin, count(p) AS n_rows
FROM (VALUES (0, '0% Missing', -1, 0), (1, '1–10%', 0, 10), (2, '11–30%', 10, 30),
             (3, '31–50%', 30, 50), (4, '>50%', 50, 100)) b(bin_order, bin, lo, hi)
LEFT JOIN pct ON p > lo AND p <= hi GROUP BY ALL"""))
def c4(t):
    return missing.missing_report(Profile(t("li_gappy")))["missing_row_distribution"]


PAIRS = [(a, b) for i, a in enumerate(GAPPY) for b in GAPPY[i + 1:]]


@query("c5_missing_cooccurrence", on("li_gappy", more="pairs AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, corr(("{a}" IS NULL)::INT, ("{b}" IS NULL)::INT) AS value,
  avg(("{a}" IS NULL)::INT) AS fa, avg(("{b}" IS NULL)::INT) AS fb FROM li_gappy""" for a, b in PAIRS) + ")",
    body="""SELECT col_a, col_b, round(value, 4) AS value FROM pairs
WHERE fa >= 0.05 AND fb >= 0.05 AND abs(value) >= 0.134111"""))
def c5(t):
    from plumbline.functions.columns import rounded
    return rounded(missing.missing_report(Profile(t("li_gappy")))["missing_cooccurrence"], "value")


@query("m2_missing_ranking", on("li_gappy", more="m AS (" + union("""
SELECT '@n' AS "column", 100.0 * count(*) FILTER (@c IS NULL) / count(*) AS p FROM li_gappy""", GAPPY) + ")",
    body='SELECT "column", round(p, 4) AS missing_pct FROM m WHERE p > 0 ORDER BY p DESC'))
def m2(t):
    from plumbline.functions.columns import rounded
    p = Profile(t("li_gappy"))
    return rounded(missing.missing_ranking(p.df, p.features), "missing_pct")


# ---- numeric ----

SUMMARY = """
SELECT '@n' AS "column", count(@c) AS count, round(avg(@c), 4) AS mean, round(stddev_samp(@c), 4) AS std,
  round(min(@c)::DOUBLE, 4) AS min, round(max(@c)::DOUBLE, 4) AS max,
  round(quantile_cont(@c::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(@c::DOUBLE, 0.75), 4) AS q3,
  round(quantile_cont(@c::DOUBLE, 0.75) - quantile_cont(@c::DOUBLE, 0.25), 4) AS iqr,
  round(skewness(@c), 4) AS skewness,
  round(sum(CASE WHEN @c = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 4) AS zero_frac,
  round(100.0 * (count(*) - count(@c)) / count(*), 4) AS missing_pct
FROM {table} HAVING count(DISTINCT @c) <> 1"""


def _summary(df):
    return rounded(df, "mean", "std", "min", "max", "q1", "q3", "iqr", "skewness", "zero_frac", "missing_pct")


@query("d1_numeric_summary", union(SUMMARY.format(table="lineitem"), LINEITEM))
def d1(t):
    return _summary(numeric.numeric_summary(t("lineitem"), LINEITEM))


@query("d1_numeric_summary_gappy", on("li_gappy", body=union(SUMMARY.format(table="li_gappy"), GAPPY_NUMERIC)))
def d1_gappy(t):
    p = Profile(t("li_gappy"))
    return _summary(numeric.numeric_summary(p.df, p.numeric, p.n_rows))


SHAPE = """
SELECT '@n' AS "column", skewness(@c) AS s, kurtosis(@c) AS k, count(DISTINCT @c) AS nd,
  quantile_cont(@c::DOUBLE, 0.25) AS q1, quantile_cont(@c::DOUBLE, 0.75) AS q3 FROM {table}"""


@query("d2_skew_kurtosis", on("li_redundant", more="f AS (" + union(SHAPE.format(table="li_redundant"), REDUNDANT)
                              + ")", body="""
SELECT "column", round(s, 3) AS skewness, round(k, 3) AS kurtosis FROM f WHERE nd >= 10"""))
def d2(t):
    p = Profile(t("li_redundant"))
    return rounded(numeric.skew_kurtosis(p.df, p.numeric), "skewness", "kurtosis", digits=3)


EVENTS_SHAPE = "f AS (" + union(SHAPE.format(table="events"), ["value"]) + ")"
OUTSIDE = """
SELECT '@n' AS "column", round(100.0 * avg(CASE WHEN @c < q1 - 1.5 * (q3 - q1) OR @c > q3 + 1.5 * (q3 - q1)
  THEN 1.0 WHEN @c IS NOT NULL THEN 0.0 END), 2) AS outlier_pct
FROM {table}, f WHERE f."column" = '@n'"""


@query("d3_iqr_outliers", on("li_redundant", more="f AS (" + union(SHAPE.format(table="li_redundant"), REDUNDANT)
                             + ")", body=union(OUTSIDE.format(table="li_redundant"), REDUNDANT)))
def d3(t):
    p = Profile(t("li_redundant"))
    return numeric.iqr_outliers(p.df, p.numeric, p.n_rows)


CLASSIFY = """
SELECT f."column", round(s, 3) AS skewness, round(k, 3) AS kurtosis, outlier_pct,
  CASE WHEN abs(s) < 0.5 AND abs(k) < 1 THEN 'Gaussian-like' ELSE 'Heavy-tailed / Skewed' END
    AS distribution_type,
  abs(k) > 3 AS heavy_tailed,
  abs(k) > 3 AND s > 1 AS suggest_log_transform,
  abs(k) > 3 AND abs(s) <= 1 AS suggest_robust_loss
FROM f JOIN o ON f."column" = o."column" WHERE nd >= 10"""


@query("d4_distribution_class", on("li_redundant", more="f AS (" + union(SHAPE.format(table="li_redundant"),
       REDUNDANT) + "), o AS (" + union(OUTSIDE.format(table="li_redundant"), REDUNDANT) + ")", body=CLASSIFY))
def d4(t):
    p = Profile(t("li_redundant"))
    return rounded(numeric.outlier_report(p.df, p.numeric, p.n_rows), "skewness", "kurtosis", digits=3)


@query("d4_distribution_class_events", on(more=EVENTS_SHAPE + ", o AS (" + union(
    OUTSIDE.format(table="events"), ["value"]) + ")", body=CLASSIFY))
def d4_events(t):
    return rounded(numeric.outlier_report(t("events"), ["value"]), "skewness", "kurtosis", digits=3)


@query("d4_outliers_are_signal", on("li_redundant", more="f AS (" + union(SHAPE.format(table="li_redundant"),
       REDUNDANT) + ")", body="""
SELECT count(*) FILTER (abs(k) > 3) AS n_heavy, count(*) FILTER (NOT abs(k) > 3) AS n_safe,
  count(*) FILTER (abs(k) > 3) > 0 AS outliers_are_signal FROM f WHERE nd >= 10"""))
def d4_table(t):
    p = Profile(t("li_redundant"))
    return numeric.outliers_are_signal(p.df, p.numeric)


HEALTH = """
SELECT '@n' AS "column", count(DISTINCT @c) AS nd, count(*) AS rows, count(@c) AS n,
  count(*) FILTER (@c = 0) AS zeros,
  (SELECT bool_and(x >= prev OR prev IS NULL) AND bool_and(x IS NOT NULL) FROM (
     SELECT @c AS x, lag(@c) OVER (ORDER BY {order}) AS prev FROM {table})) AS mono FROM {table}"""
DROPS = """
d AS (SELECT "column", CASE
    WHEN mono AND (nd + CASE WHEN n < rows THEN 1 ELSE 0 END) / rows > 0.95 THEN 'monotonic'
    WHEN nd + CASE WHEN n < rows THEN 1 ELSE 0 END <= 1 THEN 'constant'
    WHEN (rows - n) / rows > 0.7 THEN 'mostly_missing'
    WHEN zeros / rows > 0.95 AND nd > 2 THEN 'mostly_zero' END AS reason FROM h)"""


@query("d5_drop_candidates", on("li_redundant", more="h AS (" + union(
    HEALTH.format(table="li_redundant", order="l_orderkey, l_linenumber"), REDUNDANT) + f"), {DROPS}", body="""
SELECT "column", 'drop' AS action, reason FROM d WHERE reason IS NOT NULL"""))
def d5(t):
    p = Profile(t("li_redundant"))
    return numeric.drop_candidates(p.df, p.numeric)


@query("d5_drop_monotonic", on(more="h AS (" + union(
    HEALTH.format(table="orders", order="o_orderkey"), ["o_orderkey", "o_custkey", "o_totalprice"])
    + f"), {DROPS}", body="""SELECT "column", 'drop' AS action, reason FROM d WHERE reason IS NOT NULL"""))
def d5_monotonic(t):
    return numeric.drop_candidates(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey")


LOGS = """
SELECT '@n' AS "column", skewness(coalesce(@c, 0)::DOUBLE) AS s, count(DISTINCT coalesce(@c, 0)) AS nd,
  min(coalesce(@c, 0)) AS lo, max(coalesce(@c, 0)) AS hi, avg(coalesce(@c, 0)) AS m,
  count(*) FILTER (coalesce(@c, 0) = 0) AS zeros FROM {table}"""
LOG_CHOICE = """
SELECT "column", CASE WHEN zeros > 0 THEN 'log1p' ELSE 'log' END AS action, 'skewed' AS reason
FROM l WHERE nd >= 10 AND s > 1.0 AND NOT (lo >= -180 AND hi <= 180 AND m <> 0)"""


@query("d6_log_candidates", on(more="l AS (" + union(LOGS.format(table="events"), ["value", "user_id"]) + ")",
                               body=LOG_CHOICE))
def d6(t):
    return numeric.log_candidates(t("events"), ["value", "user_id"])


@query("d6_log_candidates_documents", on(more="l AS (" + union(LOGS.format(table="documents"), ["n_chars"]) + ")",
                                         body=LOG_CHOICE))
def d6_documents(t):
    return numeric.log_candidates(t("documents"), ["n_chars"])


@query("d7_redundant_098", on("li_redundant", more="p AS (" + "\nUNION ALL\n".join(
    f"""SELECT '{b}' AS r, '{a}' AS b, abs(CASE WHEN stddev_samp("{a}") > 0 AND stddev_samp("{b}") > 0
  THEN corr("{a}", "{b}") END) AS v FROM li_redundant"""
    for i, a in enumerate(REDUNDANT) for b in REDUNDANT[i + 1:]) + ")", body="""
SELECT r AS redundant_column, b AS base_column, round(v, 4) AS value,
  'Redundant feature: ''' || r || ''' is ' || format('{:.2f}', v) || ' correlated with ''' || b || '''' AS alert
FROM p WHERE v > 0.98"""))
def d7(t):
    from plumbline.functions.columns import rounded
    p = Profile(t("li_redundant"))
    return rounded(numeric.redundant_columns(p.df, p.numeric, p.means), "value")


CAT_HEALTH = """
SELECT '@n' AS "column", count(DISTINCT coalesce(@c::VARCHAR, 'nan')) / count(*) AS ratio,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM {table} GROUP BY @c)) / count(*) AS top FROM {table}"""


@query("d8_categorical_health", on(more="h AS (" + union(
    CAT_HEALTH.format(table="customer"), ["c_name", "c_mktsegment"]) + ")", body="""
SELECT "column", 'high_cardinality' AS issue, round(ratio, 4) AS value FROM h WHERE ratio > 0.8
UNION ALL SELECT "column", 'near_zero_variance', round(top, 4) FROM h WHERE top > 0.99"""))
def d8(t):
    from plumbline.functions.columns import rounded
    return rounded(numeric.categorical_health(t("customer"), ["c_name", "c_mktsegment"]), "value")


@query("d9_structural_score", on("li_redundant", more="h AS (" + union(
    HEALTH.format(table="li_redundant", order="l_orderkey, l_linenumber"), REDUNDANT) + f"), {DROPS}", body="""
SELECT floor(100 * (1 - count(reason) / 8))::INT AS score FROM d"""))
def d9(t):
    p = Profile(t("li_redundant"))
    return numeric.structural_score(numeric.drop_candidates(p.df, p.numeric), len(p.df.columns))


@query("d10_data_health_report")
def d10(t):
    return numeric.data_health_report(Profile(t("li_redundant")))


HISTOGRAM = """
e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {table}),
k AS (SELECT least(floor(({c} - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM {table}, e GROUP BY 1)
"""


@query("d11_histogram_30", on(more=HISTOGRAM.format(c="l_extendedprice", table="lineitem"), body="""
SELECT b.bin::INT AS bin, round(lo + b.bin * ((hi - lo) / 30), 4) AS bin_start, coalesce(n, 0) AS n
FROM range(30) b(bin) CROSS JOIN e LEFT JOIN k ON k.bin = b.bin"""))
def d11(t):
    from plumbline.functions.columns import rounded
    return rounded(numeric.histogram(t("lineitem"), "l_extendedprice"), "bin_start")


@query("m1_skew_ranking", union("SELECT '@n' AS \"column\", round(skewness(@c), 3) AS skewness FROM lineitem",
                                LINEITEM + ["l_extendedprice"]))
def m1(t):
    return numeric.skew_ranking(t("lineitem"), LINEITEM + ["l_extendedprice"])


# ---- categorical ----

FILLED = "SELECT coalesce(@c::VARCHAR, 'MISSING') AS v, @c AS raw FROM li_gappy"


@query("e1_categorical_summary", on("li_gappy", body=union(f"""
SELECT '@n' AS "column", count(DISTINCT v) AS n_unique,
  round(100.0 * count(*) FILTER (raw IS NULL) / count(*), 4) AS missing_pct,
  round((SELECT max(k) FROM (SELECT count(*) AS k FROM ({FILLED}) GROUP BY v)) / count(*), 6) AS most_frequent_pct,
  count(DISTINCT v) > 50 AS high_cardinality FROM ({FILLED})""", GAPPY_CATEGORICAL)))
def e1(t):
    from plumbline.functions.columns import rounded
    p = Profile(t("li_gappy"))
    out = rounded(categorical.categorical_summary(p.df, p.categorical), "missing_pct")
    return rounded(out, "most_frequent_pct", digits=6)


@query("e2_top5_categories", on("li_gappy", body=union(f"""
SELECT * FROM (SELECT '@n' AS "column", (row_number() OVER (ORDER BY count(*) DESC, v))::INT AS rank, v AS value,
  round(count(*) / (SELECT count(*) FROM li_gappy), 6) AS share FROM ({FILLED}) GROUP BY v
  ORDER BY rank LIMIT 5)""", GAPPY_CATEGORICAL)))
def e2(t):
    from plumbline.functions.columns import rounded
    p = Profile(t("li_gappy"))
    return rounded(categorical.top_categories(p.df, p.categorical), "share", digits=6)
