"""Summary, rolling statistics, autocorrelation, decomposition, stationarity."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import (CHUNK_ROWS, chunk_window, order_statistics, overlapped,
                                         running_sums)
from plumbline.functions.session import cut_lineage
from plumbline.series.prepare import KEY, SeriesSet

DS = F.timestamp_micros


def series_summary(s: SeriesSet) -> DataFrame:
    """``series_id, mean, std, min, max, median, missing_pct``."""
    counts = s.points.groupBy(KEY, "y").agg(F.count("*").alias("k"))
    basic = s.points.groupBy(KEY).agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min("y").alias("min"),
        F.max("y").alias("max"))
    gaps = s.spec.select(KEY, ((1 - F.col("n") / F.col("n_expected")) * 100).alias("missing_pct"))
    return (basic.join(order_statistics(counts, [KEY], "y", "k", {"median": 0.5}), KEY)
            .join(gaps, KEY).select(KEY, "mean", "std", "min", "max", "median", "missing_pct"))


def rolling_stats(s: SeriesSet, window: int = 12) -> DataFrame:
    """``series_id, ds, y, rolling_mean, rolling_std`` over the last min(window, n / 3) points.

    Null until the window is full.
    """
    size = F.least(F.lit(window), F.floor(F.col("n") / 3).cast("int"))
    rows = overlapped(s.points.withColumn("_w", size), [KEY], before=window - 1)
    mean = std = F.lit(None).cast("double")
    sizes = [r["_w"] for r in s.spec.select(size.alias("_w")).distinct().collect()]
    for w in (w for w in sizes if w >= 1):
        frame = chunk_window([KEY]).rowsBetween(-(w - 1), 0)
        full = (F.col("_w") == w) & (F.col("pos") >= w - 1)
        mean = F.when(full, F.avg("y").over(frame)).otherwise(mean)
        std = F.when(full, F.stddev_samp("y").over(frame)).otherwise(std)
    return (rows.withColumns({"rolling_mean": mean, "rolling_std": std}).filter("_own")
            .select(KEY, DS("t").alias("ds"), "y", "rolling_mean", "rolling_std"))


def lag_sums(points: DataFrame, by: list[str], lags: int) -> DataFrame:
    """``by..., n, s0..s{lags}``: sums of products of centred values ``lag`` positions apart."""
    mean = points.groupBy(*by).agg(F.avg("y").alias("_mean"))
    rows = overlapped(points.join(mean, by).withColumn("e", F.col("y") - F.col("_mean")),
                      by, before=lags)
    w = chunk_window(by)
    shifted = rows.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    products = [F.sum(F.col("e") * F.col("e" if k == 0 else f"e{k}")).alias(f"s{k}")
                for k in range(lags + 1)]
    return shifted.filter("_own").groupBy(*by).agg(F.count("*").alias("n"), *products)


def _acf_lags(n: Column, lags: int) -> Column:
    return F.least(F.lit(lags), F.floor(n / 2).cast("int") - 1)


def acf(s: SeriesSet, lags: int = 40) -> DataFrame:
    """``series_id, lag, acf, band, significant``."""
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", "s0").alias("acf"))
                     for k in range(lags + 1)])
    band = F.lit(1.96) / F.sqrt("n")
    return (lag_sums(s.points, [KEY], lags).select(KEY, "n", F.inline(rows))
            .filter(F.col("lag") <= _acf_lags(F.col("n"), lags))
            .select(KEY, "lag", "acf", band.alias("band"),
                    F.coalesce(F.abs("acf") > band, F.lit(False)).alias("significant")))


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive coefficients of the given order and all partial autocorrelations."""
    phi, partial, err = np.zeros(0), [1.0], r[0]
    for k in range(1, order + 1):
        if err <= 0:
            break
        last = (r[k] - phi @ r[k - 1:0:-1]) / err if k > 1 else r[1] / err
        phi = np.append(phi - last * phi[::-1], last)
        partial.append(last)
        err *= 1 - last * last
    return phi, np.array(partial)


def pacf(s: SeriesSet, lags: int = 40) -> DataFrame:
    """``series_id, lag, pacf, band, significant`` (Yule-Walker, sums divided by n - lag).

    Python sees the ``lags + 1`` sums of a series, never its points.
    """
    sums = lag_sums(s.points, [KEY], lags).select(
        KEY, "n", F.array(*[F.col(f"s{k}") for k in range(lags + 1)]).alias("s"),
        _acf_lags(F.col("n"), lags).alias("m"))

    def solve(batches):
        for pdf in batches:
            out = []
            for key, n, sums_, m in zip(pdf[KEY], pdf["n"], pdf["s"], pdf["m"]):
                if m < 0:
                    continue
                r = np.asarray(sums_)[:m + 1] / (n - np.arange(m + 1))
                _, partial = levinson(r, m)
                out += [(key, k, float(v), 1.96 / math.sqrt(n)) for k, v in enumerate(partial)]
            yield pd.DataFrame(out, columns=[KEY, "lag", "pacf", "band"])

    return (sums.mapInPandas(solve, f"{KEY} string, lag int, pacf double, band double")
            .withColumn("significant", F.abs("pacf") > F.col("band")))


def seasonal_decompose(s: SeriesSet) -> DataFrame:
    """``series_id, ds, y, trend, seasonal, residual``: additive, centred moving average.

    The ends of the trend continue the line through the ``period`` nearest
    trend points; seasonal means are centred.
    """
    pts = s.points.join(s.spec.select(KEY, "period"), KEY).filter("n >= 4 and period >= 1")
    periods = [r["period"] for r in s.spec.filter("n >= 4").select("period").distinct().collect()]
    reach = max([p // 2 for p in periods], default=0)
    rows = overlapped(pts, [KEY], before=reach, after=reach)
    w, trend = chunk_window([KEY]), F.lit(None).cast("double")
    for p in periods:
        k = p // 2
        total = F.sum("y").over(w.rowsBetween(-k, k))
        if p % 2 == 0:
            total = total - (F.lag("y", k).over(w) + F.lead("y", k).over(w)) / 2
        inside = (F.col("period") == p) & F.col("pos").between(F.lit(k), F.col("n") - 1 - k)
        trend = F.when(inside, total / p).otherwise(trend)
    smooth = (rows.withColumn("trend", trend).filter("_own")
              .select(KEY, "t", "y", "pos", "n", "period", "trend"))
    front, back = F.floor(F.col("period") / 2), F.col("n") - 1 - F.floor(F.col("period") / 2)
    left = F.col("pos").between(front, F.least(front + F.col("period"), back) - 1)
    right = F.col("pos").between(F.greatest(front, back - F.col("period")), back - 1)
    at = lambda side, v: F.when(side, v)
    # the two end lines need at most 2 x period points per series
    lines = smooth.filter(left | right).groupBy(KEY).agg(
        F.regr_slope(at(left, F.col("trend")), F.col("pos")).alias("k1"),
        F.regr_intercept(at(left, F.col("trend")), F.col("pos")).alias("b1"),
        F.regr_slope(at(right, F.col("trend")), F.col("pos")).alias("k2"),
        F.regr_intercept(at(right, F.col("trend")), F.col("pos")).alias("b2"))
    full = (F.when(F.col("trend").isNotNull(), F.col("trend"))
            .when(F.col("pos") < front, F.col("b1") + F.col("k1") * F.col("pos"))
            .otherwise(F.col("b2") + F.col("k2") * F.col("pos")))
    detrended = (smooth.join(lines, KEY, "left").withColumn("trend", full)
                 .withColumn("phase", F.col("pos") % F.col("period")))
    means = detrended.groupBy(KEY, "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("m"))
    centre = means.groupBy(KEY).agg(F.avg("m").alias("c"))
    seasonal = means.join(centre, KEY).select(KEY, "phase", (F.col("m") - F.col("c")).alias("seasonal"))
    return (detrended.join(seasonal, [KEY, "phase"])
            .select(KEY, DS("t").alias("ds"), "y", "trend", "seasonal",
                    (F.col("y") - F.col("trend") - F.col("seasonal")).alias("residual")))


# ---- stationarity ----

# KPSS critical values for p = 0.10, 0.05, 0.025, 0.01 (level stationarity).
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]

# MacKinnon (1994, 2010) response surfaces for the test with a constant.
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_SWITCH, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
                "5%": [-2.86154, -2.8903, -4.234, -40.040],
                "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _bartlett(prefix: DataFrame, by: list[str], widths: dict[str, Column]) -> DataFrame:
    """Bartlett-weighted autocovariance sums from prefix sums of the residuals.

    The weighted sum over lags up to L equals the sum of squares of all sums of
    L + 1 neighbours (zeros beyond the ends) over L + 1.  A sum of neighbours is
    a difference of two prefix sums, so any bandwidth costs one equi-join
    instead of L lags.  ``prefix`` has ``by..., pos, n, p`` with p the sum of
    the residuals up to and including pos; the whole sums to zero.
    """
    out = None
    for name, width in widths.items():
        here = prefix.withColumn("_w", width + 1)
        ahead = here.select(*by, (F.col("pos") - F.col("_w")).alias("pos"), F.col("p").alias("q"))
        # full windows; left and right ends where the window sticks out
        p, q = F.col("p"), F.col("q")
        squares = (F.when(F.col("pos") < F.col("n") - F.col("_w"), (q - p) * (q - p))
                   .otherwise(p * p) + F.when(F.col("pos") < F.col("_w"), p * p).otherwise(0.0))
        sums = (here.join(ahead, [*by, "pos"], "left").groupBy(*by)
                .agg((F.sum(squares) / F.max("_w")).alias(name)))
        out = sums if out is None else out.join(sums, by)
    return out


def kpss_statistic(points: DataFrame, by: list[str]) -> DataFrame:
    """``by..., n, bandwidth, statistic`` of ``by..., pos, y, n``."""
    mean = points.groupBy(*by).agg(F.avg("y").alias("_mean"))
    e = points.join(mean, by).withColumn("e", F.col("y") - F.col("_mean"))
    # read by several self-joins below
    prefix = cut_lineage(
        running_sums(e.select(*by, "pos", "n", "e"), by, ["pos"], {"before": F.col("e")})
        .select(*by, "pos", "n", (F.col("before") + F.col("e")).alias("p"), "e"))
    sizes = prefix.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("p") * F.col("p")).alias("pp"),
                                    F.sum(F.col("e") * F.col("e")).alias("g0"))
    # automatic bandwidth (Hobijn et al. 1998) from lags up to n^(2/9): two Bartlett sums
    # of neighbouring widths give the plain and the lag-weighted sums of autocovariances
    c = F.floor(F.pow("n", F.lit(2.0 / 9.0))).cast("bigint")
    pair = _bartlett(prefix, by, {"b1": c, "b0": c - 1})
    s1 = (F.col("b1") - F.col("b0")) * F.col("c") * (F.col("c") + 1)
    s0 = F.col("b1") + F.col("s1") / (F.col("c") + 1)
    ratio = F.try_divide("s1", "s0")
    width = F.floor(F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
                    * F.pow("n", F.lit(1.0 / 3.0))).cast("bigint")
    tuned = (sizes.join(pair, by).withColumn("c", c).withColumn("s1", s1).withColumn("s0", s0)
             .withColumn("bandwidth", F.least(F.coalesce(width, F.lit(0).cast("bigint")),
                                              F.col("n") - 1)))
    lr = _bartlett(prefix.join(tuned.select(*by, "bandwidth"), by), by, {"lr": F.col("bandwidth")})
    return tuned.join(lr, by).select(*by, "n", "bandwidth", F.try_divide(
        F.col("pp"), F.col("n") * F.col("lr")).alias("statistic"))


def kpss_pvalue(statistic: Column) -> Column:
    """Interpolated in the table, clipped to its ends."""
    p = F.lit(KPSS_P[-1])
    for i in reversed(range(3)):
        a, b, pa, pb = KPSS_CRITICAL[i], KPSS_CRITICAL[i + 1], KPSS_P[i], KPSS_P[i + 1]
        p = F.when(statistic <= b, F.lit(pa) + (statistic - a) * ((pb - pa) / (b - a))).otherwise(p)
    return F.when(statistic <= KPSS_CRITICAL[0], F.lit(KPSS_P[0])).otherwise(p)


def kpss_test(s: SeriesSet) -> DataFrame:
    """``series_id, test, bandwidth, statistic, p_value, is_stationary`` and the critical values (level stationarity)."""
    p = kpss_pvalue(F.col("statistic"))
    critical = [F.lit(c).alias(f"crit_{100 * a:g}".replace(".", "_")) for a, c in zip(KPSS_P, KPSS_CRITICAL)]
    return (kpss_statistic(s.points, [KEY]).filter("statistic is not null")
            .select(KEY, F.lit("kpss").alias("test"), "bandwidth", "statistic", p.alias("p_value"),
                    (p > 0.05).alias("is_stationary"), *critical))


def adf_pvalue(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    coef = ADF_SMALL_P if t <= ADF_SWITCH else ADF_LARGE_P
    z = sum(c * t ** i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))


def _least_squares(gram: np.ndarray, cols: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and inverse matrix of y on cols, from cross products."""
    xx, xy = gram[np.ix_(cols, cols)], gram[cols, y]
    # scale to a unit diagonal: levels and differences differ by orders of magnitude
    d = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inv = np.linalg.pinv(xx / np.outer(d, d), rcond=1e-13) / np.outer(d, d)
    beta = inv @ xy
    return beta, float(max(gram[y, y] - beta @ xy, 0.0)), inv


def chunk_arrays(points: DataFrame, by: list[str], before: int = 0, rows: int = CHUNK_ROWS,
                 keep: list[str] = ()) -> DataFrame:
    """One row per chunk of a series: ``by..., chunk, start, skip, ys, n``.

    ``ys`` starts at position ``start``; its first ``skip`` values belong to the
    previous chunk.  No array is longer than ``rows + before``.
    """
    cut = overlapped(points, by, before=before, rows=rows)
    return (cut.groupBy(*by, F.col("_chunk").alias("chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "y", *keep))).alias("_a"),
                 F.count_if(~F.col("_own")).cast("int").alias("skip"), F.max("n").alias("n"),
                 F.count_if("_own").alias("_owned"))
            .filter("_owned > 0").drop("_owned")
            .select(*by, "chunk", "skip", "n", F.col("_a.pos")[0].alias("start"),
                    F.col("_a.y").alias("ys"), *[F.col(f"_a.{k}").alias(k) for k in keep]))


def adf_test(s: SeriesSet) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag by AIC.

    ``series_id, test, lags, statistic, p_value, is_stationary, crit_1, crit_5, crit_10``.
    Chunks of each series give cross products of the level, the lagged
    differences and the constant; their sums and the few head points are all
    the solver of a series sees.
    """
    longest = s.spec.agg(F.max("n")).first()[0] or 0
    reach = adf_max_lag(longest) + 1
    # differences and a level shifted by the mean keep the sums well conditioned
    mean = s.points.groupBy(KEY).agg(F.avg("y").alias("_mean"))
    pts = s.points.join(mean, KEY).withColumn("y", F.col("y") - F.col("_mean"))
    chunks = chunk_arrays(pts, [KEY], before=reach, rows=max(CHUNK_ROWS, 64 * reach))

    def design(ys: np.ndarray, m: int, first: int) -> np.ndarray:
        """Rows t = first.. of [level, lagged differences 1..m, constant, difference]."""
        d = np.diff(ys)
        t = np.arange(first, len(ys))
        return np.column_stack([ys[t - 1], *[d[t - 1 - k] for k in range(1, m + 1)],
                                np.ones(len(t)), d[t - 1]])

    def partial(batches):
        for pdf in batches:
            out = []
            for key, start, skip, n, ys in zip(pdf[KEY], pdf["start"], pdf["skip"], pdf["n"], pdf["ys"]):
                m, ys = adf_max_lag(n), np.asarray(ys, float)
                x = design(ys, m, max(int(skip), m + 1))
                g = x.T @ x
                i, j = np.triu_indices(m + 3)
                out.append(pd.DataFrame({KEY: key, "n": n, "k": i * (m + 3) + j, "v": g[i, j]}))
                if start == 0:
                    head = ys[:m + 2]
                    out.append(pd.DataFrame({KEY: key, "n": n, "k": -1 - np.arange(len(head)), "v": head}))
            if out:
                yield pd.concat(out)

    sums = (chunks.mapInPandas(partial, f"{KEY} string, n bigint, k bigint, v double")
            .groupBy(KEY, "n", "k").agg(F.sum("v").alias("v")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [KEY, "lags", "statistic", "p_value", "crit_1", "crit_5", "crit_10"]
        n = int(pdf["n"].iloc[0])
        m = adf_max_lag(n)
        if n < 6:
            return pd.DataFrame([], columns=columns)
        size, g = m + 3, np.zeros((m + 3, m + 3))
        cells = pdf[pdf["k"] >= 0]
        i, j = cells["k"].to_numpy() // size, cells["k"].to_numpy() % size
        g[i, j] = g[j, i] = cells["v"]
        head = pdf[pdf["k"] < 0].sort_values("k", ascending=False)["v"].to_numpy()
        rows, best = n - 1 - m, None
        for lag in range(m + 1):
            cols = [0, *range(1, lag + 1), m + 1]
            rss = _least_squares(g, cols, m + 2)[1]
            aic = rows * math.log(max(rss, 1e-300) / rows) + 2 * len(cols)
            if best is None or aic < best[0]:
                best = (aic, lag)
        lag = best[1]
        # the final fit also uses the points the longest lag had to leave out
        keep = [0, *range(1, lag + 1), m + 1, m + 2]
        early = design(head[:m + 1], lag, lag + 1)
        g = g[np.ix_(keep, keep)] + early.T @ early
        beta, rss, inv = _least_squares(g, list(range(lag + 2)), lag + 2)
        used = n - 1 - lag
        sigma2 = rss / max(used - (lag + 2), 1)
        if sigma2 <= 0 or inv[0, 0] <= 0:
            return pd.DataFrame([], columns=columns)
        t = float(beta[0] / math.sqrt(sigma2 * inv[0, 0]))
        crit = [sum(c / used ** p for p, c in enumerate(ADF_CRITICAL[level]))
                for level in ("1%", "5%", "10%")]
        return pd.DataFrame([(pdf[KEY].iloc[0], lag, t, adf_pvalue(t), *crit)], columns=columns)

    found = sums.groupBy(KEY).applyInPandas(
        solve, f"{KEY} string, lags int, statistic double, p_value double, crit_1 double, "
               "crit_5 double, crit_10 double")
    return found.select(KEY, F.lit("adf").alias("test"), "lags", "statistic", "p_value",
                        (F.col("p_value") < 0.05).alias("is_stationary"),
                        "crit_1", "crit_5", "crit_10")


def verdict(adf: DataFrame, kpss: DataFrame) -> DataFrame:
    """``series_id, verdict, needs_differencing`` from the two tests (either may be missing)."""
    a, k = F.col("adf"), F.col("kpss")
    name = (F.when(a.isNull() | k.isNull(), "unknown").when(a & k, "stationary")
            .when(~a & ~k, "non_stationary").otherwise("inconclusive"))
    return (adf.select(KEY, F.col("is_stationary").alias("adf"))
            .join(kpss.select(KEY, F.col("is_stationary").alias("kpss")), KEY, "full")
            .withColumn("verdict", name)
            .select(KEY, "verdict",
                    F.col("verdict").isin("non_stationary", "inconclusive").alias("needs_differencing")))
