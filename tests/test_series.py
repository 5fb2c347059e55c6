import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.series import forecast as fc
from plumbline.series import prepare as pr
from plumbline.series import stats as st

N = 10_000          # more than two chunks


def values(kind, n=N):
    rng = np.random.default_rng(len(kind))
    e = rng.normal(size=n)
    if kind == "noise":
        return e
    if kind == "walk":
        return np.cumsum(e)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.7 * y[t - 1] + e[t]
    return y + 5


@pytest.fixture(scope="module")
def long_series(spark):
    kinds = ["noise", "walk", "auto"]
    frames = [pd.DataFrame({"k": k, "ts": pd.date_range("2000-01-01", periods=N, freq="h"), "y": values(k)})
              for k in kinds]
    df = spark.createDataFrame(pd.concat(frames)).repartition(6)
    return {k: values(k) for k in kinds}, pr.prepare_series(df, "ts", "y", "k")


def by_series(df):
    return {r["series_id"]: r for r in df.collect()}


def test_frequency(long_series):
    for r in pr.infer_frequency(long_series[1]).collect():
        assert (r["freq"], r["n"], r["n_expected"]) == ("H", N, N)


def test_acf_and_pacf(long_series):
    data, s = long_series
    acf, pacf = st.acf(s, 12).toPandas(), st.pacf(s, 12).toPandas()
    for k, y in data.items():
        e = y - y.mean()
        g = np.array([e[:N - j] @ e[j:] for j in range(13)])
        got = acf[acf.series_id == k].sort_values("lag")["acf"].to_numpy()
        np.testing.assert_allclose(got, g / g[0], atol=1e-10)
        r = g / (N - np.arange(13))
        want = [1.0]
        for m in range(1, 13):
            t = np.array([[r[abs(i - j)] for j in range(m)] for i in range(m)])
            want.append(np.linalg.solve(t, r[1:m + 1])[-1])
        got = pacf[pacf.series_id == k].sort_values("lag")["pacf"].to_numpy()
        np.testing.assert_allclose(got, want, atol=1e-8)


def kpss_by_hand(y):
    n, e = len(y), y - y.mean()
    g = lambda k: e[:n - k] @ e[k:]
    c = int(n ** (2 / 9))
    s0 = e @ e / n + sum(g(i) / (n / 2) for i in range(1, c + 1))
    s1 = sum(i * g(i) / (n / 2) for i in range(1, c + 1))
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lr = (e @ e + 2 * sum(g(i) * (1 - i / (width + 1)) for i in range(1, width + 1))) / n
    return width, (np.cumsum(e) ** 2).sum() / n ** 2 / lr


def test_kpss(long_series):
    data, s = long_series
    got = by_series(st.kpss_test(s))
    for k, y in data.items():
        width, stat = kpss_by_hand(y)
        assert got[k]["bandwidth"] == width
        assert got[k]["statistic"] == pytest.approx(stat, rel=1e-8)
    assert got["noise"]["is_stationary"] and not got["walk"]["is_stationary"]


def adf_by_hand(y):
    n, m = len(y), st.adf_max_lag(len(y))
    d = np.diff(y)

    def fit(lag, first):
        t = np.arange(first, n)
        x = np.column_stack([y[t - 1], *[d[t - 1 - k] for k in range(1, lag + 1)], np.ones(len(t))])
        beta, _, _, _ = np.linalg.lstsq(x, d[t - 1], rcond=None)
        rss = ((d[t - 1] - x @ beta) ** 2).sum()
        return x, beta, rss

    aic = []
    for lag in range(m + 1):
        x, _, rss = fit(lag, m + 1)
        aic.append(len(x) * math.log(rss / len(x)) + 2 * x.shape[1])
    lag = int(np.argmin(aic))
    x, beta, rss = fit(lag, lag + 1)
    cov = np.linalg.inv(x.T @ x) * rss / (len(x) - x.shape[1])
    return lag, beta[0] / math.sqrt(cov[0, 0])


def test_adf(long_series):
    data, s = long_series
    got = by_series(st.adf_test(s))
    for k, y in data.items():
        lag, stat = adf_by_hand(y)
        assert got[k]["lags"] == lag and got[k]["statistic"] == pytest.approx(stat, rel=1e-6)
    assert got["noise"]["is_stationary"] and not got["walk"]["is_stationary"]
    assert st.adf_pvalue(-2.86154) == pytest.approx(0.05, abs=2e-4)
    verdicts = {k: r["verdict"] for k, r in by_series(st.verdict(st.adf_test(s), st.kpss_test(s))).items()}
    assert verdicts["noise"] == "stationary" and verdicts["walk"] == "non_stationary"


def test_holt_summaries_equal_the_recursion(long_series):
    data, s = long_series
    rng = np.random.default_rng(1)
    y, a, b = rng.normal(size=300).cumsum(), 0.4, 0.3
    rows = np.concatenate([st_rows[None] for st_rows in (
        fc._holt_chunk(part, np.array([a]), np.array([b]))[0] for part in np.array_split(y, 7))])
    sse, state = fc._holt_compose(rows)
    layered = fc._holt_compose(np.stack([fc._holt_merge(rows[:3]), fc._holt_merge(rows[3:])]))
    assert layered[0] == pytest.approx(sse, rel=1e-9)
    np.testing.assert_allclose(layered[1], state, rtol=1e-7)

    def run(level, trend):
        total = 0.0
        for v in y:
            e = v - level - trend
            total += e * e
            level, trend = level + trend + a * e, trend + a * b * e
        return total, (level, trend)

    # the squared error is a quadratic form of the start: solve it by hand
    base, h = run(0, 0)[0], 1.0
    grid = {(i, j): run(i * h, j * h)[0] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    q11, q22 = [(grid[p] + grid[m] - 2 * base) / 2 for p, m in (((1, 0), (-1, 0)), ((0, 1), (0, -1)))]
    q12 = (grid[1, 1] - grid[1, -1] - grid[-1, 1] + grid[-1, -1]) / 8
    r = np.array([(grid[1, 0] - grid[-1, 0]) / 4, (grid[0, 1] - grid[0, -1]) / 4])
    best = -np.linalg.solve(np.array([[q11, q12], [q12, q22]]), r)
    want, end = run(*best)
    assert sse == pytest.approx(want, rel=1e-8)
    np.testing.assert_allclose(state, end, rtol=1e-6)


def test_holt_in_layers(spark, monkeypatch):
    ts = pd.date_range("2020-01-01", periods=1000, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"ts": ts, "y": values("auto", 1000)}))
    s = pr.prepare_series(df, "ts", "y")
    whole = fc.holt_fit(s).first()
    small = st.chunk_arrays
    monkeypatch.setattr(fc, "chunk_arrays", lambda p, by, **k: small(p, by, rows=50))
    monkeypatch.setattr(fc, "CHUNK_ROWS", 50)
    monkeypatch.setattr(fc, "MERGE_ROWS", 3)
    layered = fc.holt_fit(s).first()
    for k in ("alpha", "beta", "sse", "level", "trend"):
        assert layered[k] == pytest.approx(whole[k], rel=1e-6)


def test_holt_on_a_line(spark):
    ts = pd.date_range("2020-01-01", periods=200, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"ts": ts, "y": 3.0 + 0.5 * np.arange(200)}))
    f = fc.holt_forecast(pr.prepare_series(df, "ts", "y")).toPandas()
    assert len(f) == 40 and np.abs(f["y"] - f["forecast"]).max() < 1e-6


def test_arima_orders_and_forecast(long_series):
    data, s = long_series
    fit = by_series(fc.arima_fit(s))
    assert fit["walk"]["d"] == 1 and fit["auto"]["d"] == 0 and fit["noise"]["d"] == 0
    assert fit["auto"]["p"] >= 1
    got = fc.arima_forecast(s).toPandas()
    for k, y in data.items():
        r = fit[k]
        split = int(N * 0.8)
        w = list(y[:split] if r["d"] == 0 else np.diff(y[:split], r["d"]))
        w, e = [v - r["mean"] for v in w], list(r["tail_e"])[::-1]
        level, out = y[split - 1], []
        for _ in range(N - split):
            nxt = r["const"] + sum(a * w[-1 - i] for i, a in enumerate(r["ar"])) \
                + sum(m * e[-1 - i] for i, m in enumerate(r["ma"]))
            w.append(nxt)
            e.append(0.0)
            level = nxt + r["mean"] + (level if r["d"] == 1 else 0.0)
            out.append(level)
        f = got[got.series_id == k].sort_values("pos")
        assert len(f) == N - split
        np.testing.assert_allclose(f["forecast"], out, atol=1e-6)


def test_many_lag_sums_agree(long_series):
    _, s = long_series
    wide = by_series(st.lag_sums(s.points, ["series_id"], 20))
    centred = s.points.join(s.points.groupBy("series_id").agg(F.avg("y").alias("m")), "series_id") \
        .withColumn("y", F.col("y") - F.col("m"))
    chunked = by_series(fc._lag_sums_by_chunk(centred, 20))
    for k in wide:
        np.testing.assert_allclose(chunked[k]["s"], [wide[k][f"s{i}"] for i in range(21)], rtol=1e-7, atol=1e-4)


def test_gaps_duplicates_and_irregular_series(spark):
    rows = [("a", f"2020-01-{d:02d}", float(d)) for d in (1, 2, 3, 6, 7, 8, 9, 9)] + [("a", "bad", 1.0), ("a", "2020-01-10", None)]
    rows += [("b", f"2020-01-{d:02d}", 1.0) for d in (1, 2, 3, 5, 8, 13)] + [("c", "2020-01-31", 1.0), ("c", "2020-02-29", 2.0),
                                                                             ("c", "2020-04-30", 4.0), ("c", "2020-05-31", 4.0)]
    rows += [("d", "2020-01-01", 1.0)]
    s = pr.prepare_series(spark.createDataFrame(rows, "k string, ts string, y double"), "ts", "y", "k")
    spec = by_series(s.spec)
    assert (spec["a"]["freq"], spec["a"]["n"], spec["a"]["n_expected"]) == ("D", 7, 9)
    assert (spec["c"]["freq"], spec["c"]["n_expected"]) == ("ME", 5)
    assert spec["b"]["freq"] == "D" and spec["d"]["freq"] == "unknown"
    gaps = pr.first_gaps(s, 1).toPandas().set_index("series_id")["ds"].astype(str)
    assert gaps["a"].startswith("2020-01-04") and gaps["c"].startswith("2020-03-31")
    filled = pr.fill_gaps(s).filter("series_id = 'a'").orderBy("ds").toPandas()
    np.testing.assert_allclose(filled["y"], [1, 2, 3, 4, 5, 6, 7, 8, 9])


def test_ranges_longer_than_one_array(spark):
    df = spark.createDataFrame([(0, 10_000)], "a bigint, b bigint")
    got = pr.explode_range(df, "a", "b", "i")
    assert got.count() == 10_001 and got.select("i").distinct().count() == 10_001


def test_only_texts_that_a_format_could_fit_are_tried(spark):
    texts = ["2024-02-03", "2024-02-03 04:05", "2024-02-03 04:05:06", "2024-02-03 04:05:06.000007", "2024-02-03T04:05:06",
             "2024-02-03T04:05:06+01:00", "2024-02-03T04:05:06Z", "2024/02/03", "2024/02/03 04:05:06", "02/03/2024", "02/03/2024 04:05",
             "02/03/2024 04:05:06", "03.02.2024", "03-Feb-2024", "Feb 3 2024", "3 feb 2024", "+12024-02-03", "-2024-02-03", "3 Feb 02024",
             "Feb 0000000000000000003 2024", "A", "1-URGENT", "Customer#000012345", "2024", "24-02-03", "2024-13-03", " 2024-02-03",
             "٢٠٢٤-٠٢-٠٣", "ſep 3 2024", "a 2024 " * 50, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    each = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in pr.FORMATS])
    got = df.select("i", F.unix_micros(pr.parsed_time(df, "t")).alias("got"), F.unix_micros(each).alias("each")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["each"] for r in got]
    assert sum(r["got"] is not None for r in got) >= 16
    # no time parser is called for the others
    words = df.filter("i between 20 and 22")
    tried = words.select(F.when(F.length("t") <= pr.LONGEST, F.col("t").rlike(pr.YEAR) & F.col("t").rlike(pr.SEPARATOR)).alias("x"))
    assert not any(r["x"] for r in tried.collect())
