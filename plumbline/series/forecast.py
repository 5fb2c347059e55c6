"""Baseline forecasts on a temporal split, their errors and ranking.

Fits never see a whole series.  A fit is a fold over chunks: each chunk of a
bounded number of points gives a small summary, and summaries are combined.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import unfold
from plumbline.functions.ordered import CHUNK_ROWS, chunk_window, overlapped
from plumbline.functions.session import cut_lineage
from plumbline.series.prepare import KEY, SeriesSet
from plumbline.series.stats import (_least_squares, chunk_arrays, kpss_pvalue, kpss_statistic,
                                    lag_sums, levinson)

TRAIN_SHARE = 0.8
FORECAST = [KEY, "model", "pos", "t", "y", "forecast"]


def temporal_split(s: SeriesSet) -> DataFrame:
    """``series_id, t, y, pos, n, split, part``: the first 80% are ``train``, the rest ``test``."""
    split = F.floor(F.col("n") * TRAIN_SHARE).cast("bigint")
    return s.points.withColumn("split", split).withColumn(
        "part", F.when(F.col("pos") < F.col("split"), "train").otherwise("test"))


def _test(s: SeriesSet) -> DataFrame:
    return temporal_split(s).filter("part = 'test'")


def _constant(s: SeriesSet, values: DataFrame, model: str) -> DataFrame:
    return (_test(s).join(values, KEY).withColumn("model", F.lit(model))
            .select(*FORECAST))


def naive_forecast(s: SeriesSet) -> DataFrame:
    """The last training value."""
    last = temporal_split(s).filter("pos = split - 1").select(KEY, F.col("y").alias("forecast"))
    return _constant(s, last, "naive")


def moving_average_forecast(s: SeriesSet, window: int = 7) -> DataFrame:
    """The mean of the last training values."""
    tail = (temporal_split(s).filter((F.col("pos") < F.col("split"))
                                     & (F.col("pos") >= F.col("split") - window))
            .groupBy(KEY).agg(F.avg("y").alias("forecast")))
    return _constant(s, tail, "moving_average")


# ---- additive-trend exponential smoothing ----

HOLT_GRID = 9
HOLT_ROUNDS = 3
# Summaries one task merges; longer series are merged in several layers.
MERGE_ROWS = 1024


def _holt_candidates(alpha: float, beta: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """A square grid of smoothing weights round a centre, kept inside (0, 1)."""
    step = np.linspace(-reach, reach, HOLT_GRID)
    a, b = np.meshgrid(np.clip(alpha + step, 1e-4, 0.9999), np.clip(beta + step, 1e-4, 0.9999))
    return a.ravel(), b.ravel()


def _holt_chunk(ys: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Summary of a chunk per candidate: what it does to a state (level, trend).

    The state after the chunk is A s + b and the squared one-step errors add up
    to s'Qs + 2 r's + c for the state s before it.  Columns: A (4), b (2), Q (3),
    r (2), c.
    """
    k = len(alpha)
    a = np.tile(np.eye(2), (k, 1, 1))
    b, q, r, c = np.zeros((k, 2)), np.zeros((k, 2, 2)), np.zeros((k, 2)), np.zeros(k)
    step = np.empty((k, 2, 2))
    step[:, 0, 0] = step[:, 0, 1] = 1 - alpha
    step[:, 1, 0], step[:, 1, 1] = -alpha * beta, 1 - alpha * beta
    gain = np.column_stack([alpha, alpha * beta])
    for y in ys:
        g, h = -a.sum(axis=1), y - b.sum(axis=1)       # error = g's + h
        q += g[:, :, None] * g[:, None, :]
        r += g * h[:, None]
        c += h * h
        a = step @ a
        b = (step @ b[:, :, None])[:, :, 0] + gain * y
    return np.column_stack([a.reshape(k, 4), b, q[:, 0, 0], q[:, 0, 1], q[:, 1, 1], r, c])


def _holt_merge(rows: np.ndarray) -> np.ndarray:
    """The summary of consecutive chunks from their summaries."""
    a, b, q, r, c = np.eye(2), np.zeros(2), np.zeros((2, 2)), np.zeros(2), 0.0
    for row in rows:
        ca, cb = row[:4].reshape(2, 2), row[4:6]
        cq, cr = np.array([[row[6], row[7]], [row[7], row[8]]]), row[9:11]
        c += b @ cq @ b + 2 * cr @ b + row[11]
        r = r + a.T @ (cq @ b + cr)
        q = q + a.T @ cq @ a
        a, b = ca @ a, ca @ b + cb
    return np.r_[a.ravel(), b, q[0, 0], q[0, 1], q[1, 1], r, c]


def _holt_compose(rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Best initial state folded out: (sum of squared errors, state after the last chunk)."""
    m = _holt_merge(rows)
    r, start = m[9:11], -np.linalg.pinv(np.array([[m[6], m[7]], [m[7], m[8]]])) @ m[9:11]
    return float(max(m[11] + r @ start, 0.0)), m[:4].reshape(2, 2) @ start + m[4:6]


def holt_fit(s: SeriesSet) -> DataFrame:
    """``series_id, alpha, beta, sse, level, trend, mean`` after the training part.

    Weights by a grid that is narrowed round its best point; the initial state
    is solved exactly for each candidate.
    """
    train = temporal_split(s).filter("part = 'train'")
    mean = train.groupBy(KEY).agg(F.avg("y").alias("mean"))
    # read by every round
    chunks = cut_lineage(chunk_arrays(train.join(mean, KEY).withColumn("y", F.col("y") - F.col("mean"))
                                      .withColumn("n", F.col("split")), [KEY])
                         .select(KEY, "start", "ys"))
    best = mean.select(KEY, F.lit(0.5).alias("alpha"), F.lit(0.5).alias("beta"))
    reach = 0.5
    longest = s.spec.agg(F.max("n")).first()[0] or 0
    values = [f"v{i}" for i in range(12)]
    schema = f"{KEY} string, start bigint, cand int, alpha double, beta double, " + ", ".join(
        f"{v} double" for v in values)
    for _ in range(HOLT_ROUNDS):
        def summarise(batches, reach=reach):
            for pdf in batches:
                for key, start, ys, al, be in pdf.itertuples(index=False):
                    alpha, beta = _holt_candidates(al, be, reach)
                    out = pd.DataFrame(_holt_chunk(np.asarray(ys, float), alpha, beta), columns=values)
                    out.insert(0, KEY, key)
                    out.insert(1, "start", start)
                    out.insert(2, "cand", np.arange(len(alpha)))
                    out.insert(3, "alpha", alpha)
                    out.insert(4, "beta", beta)
                    yield out

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("start")
            sse, (level, trend) = _holt_compose(pdf[values].to_numpy())
            return pd.DataFrame([(pdf[KEY].iloc[0], pdf["alpha"].iloc[0], pdf["beta"].iloc[0], sse,
                                  level, trend)],
                                columns=[KEY, "alpha", "beta", "sse", "level", "trend"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("start")
            out = pdf.head(1).drop(columns="layer").copy()
            out[values] = _holt_merge(pdf[values].to_numpy())
            return out

        parts = (chunks.join(best, KEY).select(KEY, "start", "ys", "alpha", "beta")
                 .mapInPandas(summarise, schema))
        span = CHUNK_ROWS * MERGE_ROWS
        while longest > span:
            parts = (parts.withColumn("layer", F.floor(F.col("start") / span))
                     .groupBy(KEY, "cand", "layer").applyInPandas(merge, schema))
            span *= MERGE_ROWS
        # at most MERGE_ROWS rows per candidate
        found = (parts.groupBy(KEY, "cand").applyInPandas(
                     fold, f"{KEY} string, alpha double, beta double, sse double, level double, trend double"))
        fit = found.groupBy(KEY).agg(F.min(F.struct("sse", "alpha", "beta", "level", "trend")).alias("_b"))
        best = fit.select(KEY, "_b.alpha", "_b.beta")
        reach = reach / 4
    return fit.select(KEY, "_b.*").join(mean, KEY)


def holt_forecast(s: SeriesSet) -> DataFrame:
    """Level plus trend times the steps ahead."""
    ahead = F.col("pos") - F.col("split") + 1
    return (_test(s).join(holt_fit(s), KEY)
            .withColumn("forecast", F.col("mean") + F.col("level") + ahead * F.col("trend"))
            .withColumn("model", F.lit("exp_smoothing")).select(*FORECAST))


# ---- ARIMA by Hannan-Rissanen ----

MAX_P = MAX_Q = 3
MAX_D = 2


def _differences(s: SeriesSet) -> DataFrame:
    """``series_id, d, pos, y, n``: the training part differenced 0, 1 and 2 times."""
    train = temporal_split(s).filter("part = 'train'")
    w = chunk_window([KEY])
    y, y1, y2 = F.col("y"), F.lag("y", 1).over(w), F.lag("y", 2).over(w)
    rows = (overlapped(train, [KEY], before=MAX_D).withColumns({"d1": y - y1, "d2": y - 2 * y1 + y2})
            .filter("_own"))
    cells = [[F.lit(d), F.col("pos") - d, F.col(c), F.col("split") - d]
             for d, c in ((0, "y"), (1, "d1"), (2, "d2"))]
    return unfold(rows, cells, ["d", "pos", "y", "n"], [F.col(KEY)]).filter("pos >= 0")


def choose_differencing(levels: DataFrame) -> DataFrame:
    """``series_id, d``: the fewest differences the KPSS test calls stationary, at most two."""
    tested = kpss_statistic(levels.filter(F.col("d") < MAX_D), [KEY, "d"])
    fine = F.coalesce(kpss_pvalue(F.col("statistic")) >= 0.05, F.lit(True))
    return tested.groupBy(KEY).agg(F.coalesce(F.min(F.when(fine, F.col("d"))), F.lit(MAX_D)).alias("d"))


def long_order(n: int) -> int:
    """Order of the first-stage autoregression."""
    return max(1, min(int(math.log(max(n, 2)) ** 2), n // 4))


def _stable(coef: np.ndarray) -> bool:
    """All roots of 1 - c1 z - c2 z^2 ... outside the unit circle."""
    if not len(coef):
        return True
    return bool(np.all(np.abs(np.roots(np.r_[1.0, -coef])) < 0.999))


def arima_fit(s: SeriesSet) -> DataFrame:
    """``series_id, p, d, q, aic, const, ar, ma, mean, tail_w, tail_e, tail_y`` per series.

    Residuals of a long autoregression stand in for the shocks; all orders up
    to (3, 3) are then regressions on the same cross products, summed over
    chunks.  The order with the least AIC whose polynomials are stable wins.
    """
    levels = _differences(s)
    levels = levels.join(choose_differencing(levels), [KEY, "d"])
    mean = levels.groupBy(KEY).agg(F.avg("y").alias("mean"))
    w = levels.join(mean, KEY).withColumn("y", F.col("y") - F.col("mean"))
    longest = w.agg(F.max("n")).first()[0] or 2
    top = long_order(longest)
    sums = lag_sums(w, [KEY], top) if top <= 60 else _lag_sums_by_chunk(w, top)
    arrays = sums.select(KEY, "n", F.array(*[F.col(f"s{k}") for k in range(top + 1)]).alias("s")) \
        if top <= 60 else sums
    lead = max(MAX_P, MAX_Q)

    def long_ar(batches):
        for pdf in batches:
            rows = []
            for key, n, sums_ in pdf.itertuples(index=False):
                m = long_order(n)
                phi, _ = levinson(np.asarray(sums_, float)[:m + 1], m)
                rows.append((key, phi.tolist()))
            yield pd.DataFrame(rows, columns=[KEY, "phi"])

    phis = arrays.mapInPandas(long_ar, f"{KEY} string, phi array<double>")
    chunks = (chunk_arrays(w, [KEY], before=top + lead, rows=max(CHUNK_ROWS, 8 * top))
              .join(phis, KEY).join(mean, KEY))
    size = 1 + MAX_P + MAX_Q + 1

    def partial(batches):
        """Cross products per chunk and, from the last chunk, the final values and shocks."""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ys, phi = np.asarray(row.ys, float), np.asarray(row.phi, float)
                m = len(phi)
                e = np.full(len(ys), np.nan)
                if len(ys) > m:
                    pred = np.convolve(ys, phi)[m - 1:len(ys) - 1] if m else np.zeros(len(ys))
                    e[m:] = ys[m:] - pred
                t = np.arange(max(int(row.skip), m + lead), len(ys))
                if int(row.start) > 0:
                    t = np.arange(int(row.skip), len(ys))
                z = np.column_stack([np.ones(len(t)), *[ys[t - k] for k in range(1, MAX_P + 1)],
                                     *[e[t - k] for k in range(1, MAX_Q + 1)], ys[t]])
                g = z.T @ z
                i, j = np.triu_indices(size)
                out.append(pd.DataFrame({KEY: getattr(row, KEY), "k": i * size + j, "v": g[i, j]}))
                if int(row.start) + len(ys) == int(row.n):
                    tail = np.r_[ys[::-1][:lead], e[::-1][:lead]]
                    out.append(pd.DataFrame({KEY: getattr(row, KEY), "k": -1 - np.arange(2 * lead), "v": tail}))
            if out:
                yield pd.concat(out)

    parts = (chunks.mapInPandas(partial, f"{KEY} string, k bigint, v double")
             .groupBy(KEY, "k").agg(F.sum("v").alias("v")))
    last = (temporal_split(s).filter("pos < split and pos >= split - 2").groupBy(KEY)
            .agg(F.max_by("y", "pos").alias("y1"), F.min_by("y", "pos").alias("y2")))
    chosen = levels.groupBy(KEY).agg(F.max("d").alias("d"))
    stats = parts.join(mean.join(chosen, KEY).join(last, KEY), KEY)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, mu = int(pdf["d"].iloc[0]), float(pdf["mean"].iloc[0])
        cells, tail = pdf[pdf["k"] >= 0], pdf[pdf["k"] < 0].sort_values("k", ascending=False)["v"].to_numpy()
        g = np.zeros((size, size))
        i, j = cells["k"].to_numpy() // size, cells["k"].to_numpy() % size
        g[i, j] = g[j, i] = cells["v"]
        rows, best = g[0, 0], None
        base = [0] if d < 2 else []
        for p in range(MAX_P + 1):
            for q in range(MAX_Q + 1):
                cols = base + list(range(1, p + 1)) + list(range(1 + MAX_P, 1 + MAX_P + q))
                if rows <= len(cols) + 1:
                    continue
                beta, rss, _ = _least_squares(g, cols, size - 1) if cols else (np.zeros(0), g[-1, -1], None)
                ar, ma = beta[len(base):len(base) + p], beta[len(base) + p:]
                if not (_stable(ar) and _stable(-ma)):
                    continue
                aic = rows * math.log(max(rss, 1e-300) / rows) + 2 * (len(cols) + 1)
                if best is None or aic < best[0]:
                    best = (aic, p, q, float(beta[0]) if base else 0.0, ar.tolist(), ma.tolist())
        if best is None:
            best = (float("nan"), 0, 0, 0.0, [], [])
        aic, p, q, const, ar, ma = best
        tail = np.nan_to_num(tail)
        return pd.DataFrame([(pdf[KEY].iloc[0], p, d, q, aic, const, ar, ma, mu, tail[:lead].tolist(),
                              tail[lead:].tolist(), [float(pdf["y1"].iloc[0]), float(pdf["y2"].iloc[0])])],
                            columns=[KEY, "p", "d", "q", "aic", "const", "ar", "ma", "mean", "tail_w",
                                     "tail_e", "tail_y"])

    return stats.groupBy(KEY).applyInPandas(
        solve, f"{KEY} string, p int, d int, q int, aic double, const double, ar array<double>, "
               "ma array<double>, mean double, tail_w array<double>, tail_e array<double>, "
               "tail_y array<double>")


def _lag_sums_by_chunk(w: DataFrame, top: int) -> DataFrame:
    """``lag_sums`` for many lags: one array of sums per chunk, added up per series."""
    chunks = chunk_arrays(w, [KEY], before=top, rows=max(CHUNK_ROWS, 8 * top))

    def products(batches):
        for pdf in batches:
            out = []
            for key, skip, ys in zip(pdf[KEY], pdf["skip"], pdf["ys"]):
                ys = np.asarray(ys, float)
                own = np.arange(int(skip), len(ys))
                sums = [float(ys[own[own >= k]] @ ys[own[own >= k] - k]) for k in range(top + 1)]
                out.append(pd.DataFrame({KEY: key, "k": np.arange(top + 1), "v": sums}))
            if out:
                yield pd.concat(out)

    sums = (chunks.mapInPandas(products, f"{KEY} string, k int, v double")
            .groupBy(KEY, "k").agg(F.sum("v").alias("v")))
    sizes = w.groupBy(KEY).agg(F.count("*").alias("n"))
    # top + 1 numbers per series
    return (sums.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("k", "v")))["v"].alias("s"))
            .join(sizes, KEY).select(KEY, "n", "s"))


def _arima_system(const, ar, ma, d, mu, tail_w, tail_e, tail_y):
    """Transition matrix and state whose first entry is the forecast after one step.

    State: y, y before, the last three differenced values, the last three
    shocks (zero in the future), 1.
    """
    lead = max(MAX_P, MAX_Q)
    size = 2 + 2 * lead + 1
    f = np.zeros((size, size))
    w_row = np.zeros(size)
    w_row[2:2 + len(ar)] = ar
    w_row[2 + lead:2 + lead + len(ma)] = ma
    w_row[-1] = const
    f[2] = w_row
    for k in range(1, lead):
        f[2 + k, 1 + k] = 1
        f[2 + lead + k, 1 + lead + k] = 1
    f[0] = w_row
    f[0, -1] += mu
    if d == 1:
        f[0, 0] += 1
    elif d == 2:
        f[0, 0] += 2
        f[0, 1] -= 1
    f[1, 0] = 1
    f[-1, -1] = 1
    return f, np.r_[tail_y, tail_w, tail_e, 1.0]


def arima_forecast(s: SeriesSet) -> DataFrame:
    """Forecasts of the chosen order; each chunk of the test part starts from a matrix power."""
    cut = (_test(s).withColumn("ahead", F.col("pos") - F.col("split"))
           .withColumn("chunk", F.floor(F.col("ahead") / CHUNK_ROWS)))
    # at most CHUNK_ROWS points in a group
    chunks = (cut.groupBy(KEY, "chunk")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "t", "y"))).alias("a"),
                   F.min("ahead").alias("ahead"))
              .select(KEY, "ahead", F.col("a.pos").alias("pos"), F.col("a.t").alias("t"), F.col("a.y").alias("y"))
              .join(arima_fit(s), KEY))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                f, state = _arima_system(r.const, r.ar, r.ma, r.d, r.mean, r.tail_w, r.tail_e, r.tail_y)
                state = np.linalg.matrix_power(f, int(r.ahead)) @ state
                out = np.empty(len(r.pos))
                for k in range(len(out)):
                    state = f @ state
                    out[k] = state[0]
                yield pd.DataFrame({KEY: getattr(r, KEY), "model": "arima", "pos": r.pos, "t": r.t,
                                    "y": r.y, "forecast": out})

    return chunks.mapInPandas(
        run, f"{KEY} string, model string, pos bigint, t bigint, y double, forecast double")


# ---- errors and ranking ----

MODELS = {"naive": naive_forecast, "moving_average": moving_average_forecast,
          "exp_smoothing": holt_forecast, "arima": arima_forecast}


def forecasts(s: SeriesSet, models: list[str] | None = None) -> DataFrame:
    """``series_id, model, pos, t, y, forecast`` of the test part."""
    out = None
    for name in models or list(MODELS):
        f = MODELS[name](s).select(*FORECAST)
        out = f if out is None else out.unionByName(f)
    return out


def forecast_metrics(f: DataFrame) -> DataFrame:
    """``series_id, model, rmse, mae, mape`` over the points where both values are present."""
    err = F.col("y") - F.col("forecast")
    return (f.filter("y is not null and forecast is not null and not isnan(forecast)")
            .groupBy(KEY, "model").agg(
                F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
                F.round(F.avg(F.abs(err)), 4).alias("mae"),
                F.round(F.avg(F.abs(F.try_divide(err, F.col("y") + 1e-8))) * 100, 4).alias("mape")))


def forecast_ranking(metrics: DataFrame) -> DataFrame:
    """``series_id, model, rmse, mae, mape, rank``: least error first (a handful of rows per series)."""
    order = Window.partitionBy(KEY).orderBy("rmse", "model")
    return metrics.withColumn("rank", F.row_number().over(order))
