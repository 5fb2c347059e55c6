"""Time-series operators."""

from pyspark.sql import functions as F

from checks.registry import FIXTURES, on, query, union
from plumbline.functions.columns import rounded
from plumbline.series import forecast as fc
from plumbline.series import prepare as pr
from plumbline.series import report
from plumbline.series import stats as st

# orders with times held as text: dates in two notations, one in five values unreadable
TEXT_TIMES = """
SELECT o_orderkey, o_totalprice,
  CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')
    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS mixed,
  CASE WHEN o_orderkey % 2 = 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')
    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day,
  CAST(year(o_orderdate) AS STRING) AS yr
FROM orders"""
FIXTURES["orders_text_times"] = TEXT_TIMES


def at(c="ds"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ds")


def daily(t):
    return pr.prepare_series(t("orders_daily"), "ds", "y")


def monthly(t):
    return pr.prepare_series(t("orders_monthly"), "ds", "y", "series_id")


def hourly(t):
    return pr.prepare_series(t("events_hourly"), "ds", "y", "series_id")


SERIES = {
    "daily": "s AS (SELECT 'all' AS series_id, ds::TIMESTAMP AS ds, y FROM orders_daily)",
    "monthly": "s AS (SELECT series_id, ds::TIMESTAMP AS ds, y FROM orders_monthly)",
    "hourly": "s AS (SELECT series_id, ds::TIMESTAMP AS ds, y FROM events_hourly)",
}
TABLE = {"daily": "orders_daily", "monthly": "orders_monthly", "hourly": "events_hourly"}
STEP = {"daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 1 MONTH", "hourly": "INTERVAL 1 HOUR"}
POINTS = """p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM s)"""
CALENDAR = """cal AS (SELECT series_id, unnest(generate_series(min(ds), max(ds), {step})) AS ds FROM s GROUP BY series_id)"""


def series_sql(kind, body, *more):
    return on(TABLE[kind], more=", ".join([SERIES[kind], POINTS, *more]), body=body)


# ---- detection ----

FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%Y-%m-%d %H:%M:%S']"


@query("j1_detect_datetime", on("orders_text_times", body=union(f"""
SELECT '@n' AS "column", round(avg((try_strptime(@c, {FORMATS}) IS NOT NULL)::INT), 4) AS parsed_share,
  avg((try_strptime(@c, {FORMATS}) IS NOT NULL)::INT) > 0.8 AS is_datetime FROM orders_text_times""",
    ["mixed", "day"]) + """
UNION ALL SELECT 'yr', 0.0, false"""))
def j1(t):
    return rounded(pr.detect_datetime(t("orders_text_times")), "parsed_share")


@query("j2_detect_ts_target", union(
    "SELECT '@n' AS \"column\", round(var_samp(@c), 0) AS variance FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def j2(t):
    return rounded(pr.detect_series_target(t("orders")), "variance", digits=0)


@query("j3_ts_candidates", """
SELECT 'datetime' AS role, 'o_orderdate' AS "column", true AS chosen
UNION ALL SELECT 'target', c, v = max(v) OVER () FROM (
  SELECT 'o_orderkey' AS c, var_samp(o_orderkey) AS v FROM orders UNION ALL
  SELECT 'o_custkey', var_samp(o_custkey) FROM orders UNION ALL
  SELECT 'o_totalprice', var_samp(o_totalprice) FROM orders)""")
def j3(t):
    return pr.series_candidates(t("orders"))


# ---- regular series ----

for _kind, _load in (("daily", daily), ("hourly", hourly)):
    query(f"j4_prepare_series_{_kind}", series_sql(_kind, """
SELECT cal.series_id, strftime(cal.ds, '%Y-%m-%d %H:%M:%S') AS ds, round(y, 6) AS y
FROM cal LEFT JOIN s ON s.series_id = cal.series_id AND s.ds = cal.ds""", CALENDAR.format(step=STEP[_kind])))(
        lambda t, load=_load: pr.regular_series(load(t)).select("series_id", at(), F.round("y", 6).alias("y")))

MODAL = {"daily": "D", "monthly": "MS", "hourly": "H"}
for _kind, _load in (("daily", daily), ("monthly", monthly), ("hourly", hourly)):
    query(f"j5_infer_freq_{_kind}", series_sql(_kind, f"""
SELECT series_id, CASE WHEN step = {STEP[_kind]} THEN '{MODAL[_kind]}' ELSE 'other' END AS freq, n, n_expected
FROM (SELECT series_id, count(*) AS n_expected FROM cal GROUP BY series_id) c
JOIN (SELECT series_id, any_value(n) AS n, mode(gap) AS step FROM (SELECT *, {
        "ds - lag(ds) OVER w" if _kind != "monthly" else "to_months(datediff('month', lag(ds) OVER w, ds)::INT)"} AS gap
      FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ds)) GROUP BY series_id) USING (series_id)""",
        CALENDAR.format(step=STEP[_kind])))(lambda t, load=_load: pr.infer_frequency(load(t)))

for _kind, _load in (("daily", daily), ("monthly", monthly), ("hourly", hourly)):
    query(f"j6_ts_summary_{_kind}", series_sql(_kind, """
SELECT series_id, round(avg(y), 2) AS mean, round(stddev_samp(y), 2) AS std, round(min(y), 2) AS min,
  round(max(y), 2) AS max, round(median(y), 2) AS median,
  round(100.0 * (1 - count(*) / (SELECT count(*) FROM cal c WHERE c.series_id = s.series_id)), 4) AS missing_pct
FROM s GROUP BY series_id""", CALENDAR.format(step=STEP[_kind])))(
        lambda t, load=_load: rounded(rounded(st.series_summary(load(t)), "mean", "std", "min", "max", "median",
                                              digits=2), "missing_pct"))


@query("j13_missing_timestamps_daily", series_sql("daily", """
SELECT c.series_id, 'D' AS freq, (SELECT count(*) FROM s) AS n, count(*) AS n_expected,
  count(*) FILTER (s.ds IS NULL) AS gap_count, round(100.0 * (1 - count(*) FILTER (s.ds IS NULL) / count(*)), 4) AS coverage_pct
FROM cal c LEFT JOIN s ON s.ds = c.ds GROUP BY c.series_id""", CALENDAR.format(step=STEP["daily"])))
def j13(t):
    return rounded(pr.missing_timestamps(daily(t)), "coverage_pct")


@query("j13_missing_timestamps_hourly", series_sql("hourly", """
SELECT c.series_id, 'H' AS freq, count(s.ds) AS n, count(*) AS n_expected, count(*) FILTER (s.ds IS NULL) AS gap_count,
  round(100.0 * (1 - count(*) FILTER (s.ds IS NULL) / count(*)), 4) AS coverage_pct
FROM cal c LEFT JOIN s ON s.ds = c.ds AND s.series_id = c.series_id GROUP BY c.series_id""",
                                                   CALENDAR.format(step=STEP["hourly"])))
def j13_hourly(t):
    return rounded(pr.missing_timestamps(hourly(t)), "coverage_pct")


@query("j13_first_gaps", series_sql("hourly", """
SELECT * FROM (SELECT c.series_id, (row_number() OVER (PARTITION BY c.series_id ORDER BY c.ds))::INT AS rank,
    strftime(c.ds, '%Y-%m-%d %H:%M:%S') AS ds
  FROM cal c ANTI JOIN s ON s.ds = c.ds AND s.series_id = c.series_id) WHERE rank <= 20""",
                                    CALENDAR.format(step=STEP["hourly"])))
def j13_gaps(t):
    return pr.first_gaps(hourly(t)).select("series_id", "rank", at())


@query("j23_fill_gaps", series_sql("hourly", """
SELECT series_id, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, round(CASE WHEN y IS NOT NULL THEN y ELSE
  y0 + (y1 - y0) * (epoch(ds) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 6) AS y, y IS NULL AS filled
FROM (SELECT cal.series_id, cal.ds, y,
    last_value(y IGNORE NULLS) OVER b AS y0, last_value(s.ds IGNORE NULLS) OVER b AS t0,
    first_value(y IGNORE NULLS) OVER a AS y1, first_value(s.ds IGNORE NULLS) OVER a AS t1
  FROM cal LEFT JOIN s ON s.series_id = cal.series_id AND s.ds = cal.ds
  WINDOW b AS (PARTITION BY cal.series_id ORDER BY cal.ds ROWS UNBOUNDED PRECEDING),
         a AS (PARTITION BY cal.series_id ORDER BY cal.ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
                                    CALENDAR.format(step=STEP["hourly"])))
def j23(t):
    return rounded(pr.fill_gaps(hourly(t)).select("series_id", at(), "y", "filled"), "y", digits=6)


# ---- statistics ----

@query("j14_rolling_stats", series_sql("daily", """
SELECT series_id, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, round(y, 4) AS y,
  CASE WHEN pos >= 11 THEN round(avg(y) OVER w, 4) END AS rolling_mean,
  CASE WHEN pos >= 11 THEN round(stddev_samp(y) OVER w, 4) END AS rolling_std
FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS 11 PRECEDING)"""))
def j14(t):
    return rounded(st.rolling_stats(daily(t)).select("series_id", at(), "y", "rolling_mean", "rolling_std"),
                   "y", "rolling_mean", "rolling_std")


ACF = """
SELECT series_id, lag, round(sum(e0 * e1) / any_value(v), 4) AS acf, round(1.96 / sqrt(any_value(n)), 4) AS band,
  abs(sum(e0 * e1) / any_value(v)) > 1.96 / sqrt(any_value(n)) AS significant
FROM (SELECT a.series_id, k.lag::INT AS lag, a.n, a.y - m.m AS e0, b.y - m.m AS e1, m.v
  FROM p a CROSS JOIN range(41) k(lag) JOIN p b ON b.series_id = a.series_id AND b.pos = a.pos + k.lag
  JOIN (SELECT series_id, avg(y) AS m, var_pop(y) * count(*) AS v FROM s GROUP BY series_id) m ON m.series_id = a.series_id)
WHERE lag <= least(40, n // 2 - 1) GROUP BY series_id, lag"""
for _kind, _load in (("daily", daily), ("monthly", monthly), ("hourly", hourly)):
    query(f"j11_acf_{_kind}", series_sql(_kind, ACF))(lambda t, load=_load: rounded(st.acf(load(t)), "acf", "band"))


@query("j12_pacf")
def j12(t):
    return rounded(st.pacf(monthly(t)), "pacf", "band")


DECOMPOSE = """
SELECT series_id, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, round(y, {r}) AS y, round(trend, {r}) AS trend,
  round(seasonal, {r}) AS seasonal, round(y - trend - seasonal, {r}) AS residual
FROM (SELECT *, avg(y - trend) OVER (PARTITION BY series_id, pos % {p}) - c AS seasonal FROM full_trend
  JOIN (SELECT series_id, avg(m) AS c FROM (SELECT series_id, avg(y - trend) AS m FROM full_trend
    GROUP BY series_id, pos % {p}) GROUP BY series_id) USING (series_id))"""
TREND = """
ma AS (SELECT *, CASE WHEN pos >= {k} AND pos <= n - 1 - {k} THEN ({total}) / {p} END AS raw FROM p
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING),
         o AS (PARTITION BY series_id ORDER BY pos)),
front AS (SELECT series_id, regr_slope(raw, pos) AS k, regr_intercept(raw, pos) AS b FROM ma
  WHERE pos >= {k} AND pos < least({k} + {p}, n - 1 - {k}) GROUP BY series_id),
back AS (SELECT series_id, regr_slope(raw, pos) AS k, regr_intercept(raw, pos) AS b FROM ma
  WHERE pos >= greatest({k}, n - 1 - {k} - {p}) AND pos < n - 1 - {k} GROUP BY series_id),
full_trend AS (SELECT ma.*, CASE WHEN raw IS NOT NULL THEN raw WHEN pos < {k} THEN front.b + front.k * pos
  ELSE back.b + back.k * pos END AS trend FROM ma JOIN front USING (series_id) JOIN back USING (series_id))"""
for _kind, _load, _p in (("daily", daily, 7), ("monthly", monthly, 12), ("hourly", hourly, 24)):
    _k = _p // 2
    _total = "sum(y) OVER w" + (f" - (lag(y, {_k}) OVER o + lead(y, {_k}) OVER o) / 2" if _p % 2 == 0 else "")
    query(f"j10_seasonal_decompose_{_kind}", series_sql(
        _kind, DECOMPOSE.format(p=_p, r=9 if _kind == "hourly" else 5), TREND.format(p=_p, k=_k, total=_total)))(
        lambda t, load=_load, r=9 if _kind == "hourly" else 5: rounded(st.seasonal_decompose(load(t)).select(
            "series_id", at(), "y", "trend", "seasonal", "residual"), "y", "trend", "seasonal", "residual", digits=r))


@query("j7_adf_test")
def j7(t):
    return rounded(st.adf_test(monthly(t)), "statistic", "p_value", "crit_1", "crit_5", "crit_10")


KPSS = """
e AS (SELECT p.*, y - avg(y) OVER (PARTITION BY series_id) AS e FROM p),
g AS (SELECT a.series_id, k.lag, sum(a.e * b.e) AS g FROM e a CROSS JOIN range({most}) k(lag)
  JOIN e b ON b.series_id = a.series_id AND b.pos = a.pos + k.lag GROUP BY ALL),
c AS (SELECT series_id, any_value(n) AS n, floor(any_value(n) ** (2.0 / 9.0))::INT AS c FROM e GROUP BY series_id),
h AS (SELECT series_id, any_value(c.n) AS n, sum(CASE WHEN lag = 0 THEN g WHEN lag <= c THEN 2 * g END) AS s0,
  sum(CASE WHEN lag BETWEEN 1 AND c THEN 2 * lag * g END) AS s1 FROM g JOIN c USING (series_id) GROUP BY series_id),
l AS (SELECT series_id, n, least(n - 1, floor(1.1447 * ((s1 / s0) * (s1 / s0)) ** (1.0 / 3.0) * n ** (1.0 / 3.0)))::BIGINT AS bw FROM h),
v AS (SELECT series_id, any_value(bw) AS bw, any_value(n) AS n,
  sum(CASE WHEN lag = 0 THEN g WHEN lag <= bw THEN 2 * g * (1 - lag / (bw + 1)) END) AS lr FROM g JOIN l USING (series_id) GROUP BY series_id),
q AS (SELECT series_id, sum(ps * ps) AS pp FROM (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY pos) AS ps FROM e) GROUP BY series_id),
k AS (SELECT series_id, bw, pp / (n * lr) AS stat FROM v JOIN q USING (series_id)),
r AS (SELECT *, CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat <= 0.463 THEN 0.10 + (stat - 0.347) / (0.463 - 0.347) * (0.05 - 0.10)
  WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) / (0.574 - 0.463) * (0.025 - 0.05)
  WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) ELSE 0.01 END AS pv FROM k)"""
for _kind, _load in (("daily", daily), ("monthly", monthly), ("hourly", hourly)):
    query(f"j8_kpss_test_{_kind}", series_sql(_kind, """
SELECT series_id, 'kpss' AS test, bw AS bandwidth, round(stat, 4) AS statistic, round(pv, 4) AS p_value, pv > 0.05 AS is_stationary,
  0.347::DOUBLE AS crit_10, 0.463::DOUBLE AS crit_5, 0.574::DOUBLE AS crit_2_5, 0.739::DOUBLE AS crit_1
FROM r""", KPSS.format(most=60)))(lambda t, load=_load: rounded(st.kpss_test(load(t)), "statistic", "p_value"))


@query("j9_stationarity_verdict")
def j9(t):
    s = monthly(t)
    return st.verdict(st.adf_test(s), st.kpss_test(s))


# ---- forecasts ----

SPLIT = "sp AS (SELECT *, floor(n * 0.8)::BIGINT AS split FROM p)"


@query("j15_temporal_split", series_sql("monthly", """
SELECT series_id, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, pos, split, CASE WHEN pos < split THEN 'train' ELSE 'test' END AS part
FROM sp""", SPLIT))
def j15(t):
    return fc.temporal_split(monthly(t)).select("series_id", at(F.timestamp_micros("t")), "pos", "split", "part")


SIMPLE = """f AS (SELECT t.series_id, m.model, t.ds, t.pos, t.y, m.f AS forecast FROM sp t JOIN (
  SELECT series_id, 'naive' AS model, y AS f FROM sp WHERE pos = split - 1 UNION ALL
  SELECT series_id, 'moving_average', avg(y) FROM sp WHERE pos < split AND pos >= split - 7 GROUP BY series_id) m
  USING (series_id) WHERE t.pos >= t.split)"""
FORECAST = """
SELECT series_id, model, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, round(forecast, 2) AS forecast FROM f WHERE model = '{m}'"""
for _m, _fit in (("naive", fc.naive_forecast), ("moving_average", fc.moving_average_forecast)):
    query(f"j16_{_m}_forecast" if _m == "naive" else f"j17_{_m}_forecast",
          series_sql("monthly", FORECAST.format(m=_m), SPLIT, SIMPLE))(
        lambda t, fit=_fit: rounded(fit(monthly(t)).select(
            "series_id", "model", at(F.timestamp_micros("t")), "forecast"), "forecast", digits=2))


@query("j18_holt_forecast")
def j18(t):
    return fc.holt_forecast(monthly(t)).select("series_id", "model", at(F.timestamp_micros("t")), "forecast")


@query("j19_arima_forecast")
def j19(t):
    return fc.arima_forecast(monthly(t)).select("series_id", "model", at(F.timestamp_micros("t")), "forecast")


METRICS = """
m AS (SELECT series_id, model, round(sqrt(avg((y - forecast) ** 2)), 2) AS rmse, round(avg(abs(y - forecast)), 2) AS mae,
  round(avg(abs((y - forecast) / (y + 1e-8))) * 100, 4) AS mape FROM f GROUP BY series_id, model)"""


@query("j20_forecast_metrics", series_sql("hourly", "SELECT * FROM m", SPLIT, SIMPLE, METRICS))
def j20(t):
    f = fc.forecasts(hourly(t), ["naive", "moving_average"])
    return rounded(fc.forecast_metrics(f), "rmse", "mae", digits=2)


@query("j21_forecast_ranking", series_sql("monthly", """
SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY rmse, model))::INT AS rank FROM m""", SPLIT, SIMPLE, METRICS))
def j21(t):
    f = fc.forecasts(monthly(t), ["naive", "moving_average"])
    return rounded(fc.forecast_ranking(fc.forecast_metrics(f)), "rmse", "mae", digits=2)


@query("j21_forecast_ranking_all_models")
def j21_all(t):
    return fc.forecast_ranking(fc.forecast_metrics(fc.forecasts(monthly(t))))


@query("j22_timeseries_report")
def j22(t):
    parts = report.timeseries_report(t("orders_monthly"), "ds", "y", "series_id")
    return parts["status"].join(parts["frequency"], "series_id").join(parts["stationarity"], "series_id")
