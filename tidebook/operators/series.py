"""Series statistics and forecasts on ``(series_id, ord, y)`` frames, ``ord`` dense from 0.

No window spans a series: rows are cut into chunks with a halo (``functions.chunks``), so one very long
series spreads over as many tasks as it has chunks. Per-series results are a handful of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.chunks import CHUNK_ROWS, attach_series, chunk_of, in_chunk, running_totals, with_halo
from tidebook.session import written

SERIES = ["series_id"]


def acf(series: DataFrame, nlags: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Autocorrelations for lags 0 to ``nlags``, biased denominators: ``(series_id, lag, acf)``.

    One scan. Every chunk sums its lag products around its own centre; the small chunk table then moves
    all sums to the series mean exactly, which keeps the precision of a two-pass formula.
    """
    w = in_chunk(SERIES, "ord")
    spread = with_halo(series.select("series_id", "ord", F.col("y").cast("double").alias("y")), "ord", nlags, chunk_rows)
    centre = F.avg(F.when(F.col("own"), F.col("y"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lagged = {f"y_{k}": F.lag("y", k).over(w) for k in range(1, nlags + 1)}
    rows = spread.withColumns({"c": centre, "y_0": F.col("y"), **lagged}).where("own")
    sums = [F.max("c").alias("c"), F.sum("y").alias("sum_y"), F.count("y").alias("n_y")]
    for k in range(nlags + 1):
        now, then = F.col("y") - F.col("c"), F.col(f"y_{k}") - F.col("c")
        pair = now * then
        sums += [
            F.sum(pair).alias(f"a_{k}"),
            F.sum(F.when(pair.isNotNull(), now + then)).alias(f"b_{k}"),
            F.count(pair).alias(f"n_{k}"),
        ]
    chunks = rows.groupBy("series_id", "chunk").agg(*sums)
    by_series = Window.partitionBy("series_id")
    moved = chunks.withColumn("d", F.col("c") - F.sum("sum_y").over(by_series) / F.sum("n_y").over(by_series))
    shifted = [
        F.sum(F.col(f"a_{k}") + F.col("d") * F.col(f"b_{k}") + F.col(f"n_{k}") * F.col("d") * F.col("d")).alias(f"g_{k}")
        for k in range(nlags + 1)
    ]
    gammas = moved.groupBy("series_id").agg(*shifted)
    cells = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"g_{k}"), F.col("g_0")).alias("acf")) for k in range(nlags + 1)]
    return gammas.select("series_id", F.inline(F.array(*cells)))


def _autocorrelations(acf_table: DataFrame) -> DataFrame:
    """``(series_id, r)`` with r[k] the autocorrelation of lag k; nlags + 1 numbers per series."""
    pairs = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    return acf_table.groupBy("series_id").agg(F.transform(pairs, lambda p: p["acf"]).alias("r"))


def _durbin_levinson(r: Column, order: int) -> Column:
    """Struct of ``pacf`` (lags 1 to order) and ``phi``, the autoregression coefficients of that order."""
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("pacf"))

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]

        def dot(lag_of) -> Column:
            terms = F.transform(phi, lambda v, j: v * F.get(r, lag_of(j)))
            return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

        reflect = F.try_divide(F.get(r, k) - dot(lambda j: k - 1 - j), F.lit(1.0) - dot(lambda j: j + 1))
        updated = F.transform(phi, lambda v, j: v - reflect * F.get(phi, k - 2 - j))
        return F.struct(
            F.concat(updated, F.array(reflect)).alias("phi"), F.concat(acc["pacf"], F.array(reflect)).alias("pacf")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)


def pacf(series: DataFrame, nlags: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Partial autocorrelations for lags 0 to ``nlags`` by the Durbin-Levinson recursion."""
    solved = _autocorrelations(acf(series, nlags, chunk_rows)).withColumn("s", _durbin_levinson(F.col("r"), nlags))
    values = F.concat(F.array(F.lit(1.0)), F.col("s.pacf"))
    return solved.select("series_id", F.posexplode(values).alias("lag", "pacf"))


# MacKinnon (1994) p-value polynomials and MacKinnon (2010) critical-value surfaces for a
# regression with a constant and one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL_P = [2.1659, 1.4412, 0.038269]
TAU_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
TAU_CRITICAL = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def mackinnon_p(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic."""
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefficients = TAU_SMALL_P if stat <= TAU_STAR else TAU_LARGE_P
    z = sum(c * stat**k for k, c in enumerate(coefficients))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def critical_values(nobs: int) -> dict[str, float]:
    return {level: sum(b / nobs**k for k, b in enumerate(bs)) for level, bs in TAU_CRITICAL.items()}


# Bytes of partial matrices a task holds before it passes them on; bounds its memory when series are many.
HELD_BYTES = 64 << 20


def _cross_products(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of all column pairs per series: ``(series_id, i, j, s, n)`` with i <= j.

    A task adds up one small matrix per series over all of its batches, so the shuffle carries matrices,
    not rows, however long a series is.
    """
    names, d = list(columns), len(columns)
    upper = np.triu_indices(d)

    def passed_on(held):
        for sid, (g, n) in held.items():
            yield pd.DataFrame({"series_id": sid, "i": upper[0], "j": upper[1], "s": g[upper], "n": n})

    def partial(batches):
        held: dict[str, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for sid, part in pdf.groupby("series_id", sort=False):
                x = part[names].to_numpy(dtype=float)
                g, n = held.get(sid, (np.zeros((d, d)), 0))
                held[sid] = (g + x.T @ x, n + len(x))
            if len(held) * d * d * 8 > HELD_BYTES:
                yield from passed_on(held)
                held = {}
        yield from passed_on(held)

    parts = rows.select("series_id", *names).mapInPandas(partial, "series_id STRING, i INT, j INT, s DOUBLE, n BIGINT")
    return parts.groupBy("series_id", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _solve(gram: np.ndarray, regressors: Sequence[int], response: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares from cross products: coefficients, squared residual sum and inverse matrix."""
    sub = gram[np.ix_(regressors, regressors)]
    size = np.sqrt(np.diag(sub))
    size = np.where(size == 0.0, 1.0, size)
    inverse = np.linalg.inv(sub / np.outer(size, size)) / np.outer(size, size)
    right = gram[regressors, response]
    beta = inverse @ right
    return beta, float(gram[response, response] - beta @ right), inverse


ADF_SCHEMA = (
    "series_id STRING, statistic DOUBLE, p_value DOUBLE, used_lag INT, nobs BIGINT, critical_1 DOUBLE, "
    "critical_5 DOUBLE, critical_10 DOUBLE, stationary BOOLEAN"
)


def _adf_rows(series: DataFrame, lags: int, chunk_rows: int) -> DataFrame:
    """Regression rows past each series' own lag limit: change, constant, level before, earlier changes.

    Lags beyond a series' limit are zero; its fit does not use them.
    """
    w = in_chunk(SERIES, "ord")
    spread = with_halo(series, "ord", lags + 1, chunk_rows)
    step = spread.withColumns({"level": F.lag("y").over(w), "change": F.col("y") - F.lag("y").over(w)})
    earlier = {f"change_{k}": F.coalesce(F.lag("change", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)}
    ready = F.col("own") & (F.col("ord") > F.col("limit"))
    return step.withColumns(earlier).withColumn("one", F.lit(1.0)).where(ready)


def _adf_fit(cells: pd.DataFrame, head: pd.DataFrame, d: int) -> tuple:
    """Lag by AIC on the common sample, then a fit that adds the early rows the chosen lag allows."""
    blank = (None, None, None, None, None, None, None, False)
    if cells.empty:
        return blank
    gram = np.zeros((d, d))
    gram[cells["i"], cells["j"]] = cells["s"]
    gram += np.triu(gram, 1).T
    n, limit = int(cells["n"].iloc[0]), int(head["limit"].iloc[0])
    try:
        scores = []
        for lag in range(limit + 1):
            regressors = list(range(1, 3 + lag))
            _, ssr, _ = _solve(gram, regressors, 0)
            scores.append((n * math.log(ssr / n) + 2 * len(regressors), lag))
        lag = min(scores)[1]
        y = head.sort_values("ord")["y"].to_numpy()
        dy = np.diff(y)
        early = [[dy[t], 1.0, y[t], *dy[t - lag : t][::-1]] for t in range(lag, len(dy))]
        used = gram[: 3 + lag, : 3 + lag].copy()
        if early:
            x = np.array(early)
            used += x.T @ x
            n += len(x)
        regressors = list(range(1, 3 + lag))
        beta, ssr, inverse = _solve(used, regressors, 0)
        stat = float(beta[1] / math.sqrt(ssr / (n - len(regressors)) * inverse[1, 1]))
    except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):  # constant or too short
        return blank
    p = mackinnon_p(stat)
    return (stat, p, lag, n, *critical_values(n).values(), p < 0.05)


def adf(series: DataFrame, max_lag: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag length by AIC; one row per series.

    All candidate lags are fitted from one matrix of cross products, computed in one pass. The final fit
    only adds the first few rows of the series. A constant or too short series gets NULLs.
    """
    slim = written(series.select("series_id", "ord", F.col("y").cast("double").alias("y")), "adf")
    n = F.count("y")
    longest = F.ceil(F.lit(12.0) * F.pow(n / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    limit = F.greatest(F.least(longest, F.floor(n / 2) - 2), F.lit(0)).cast("int")
    stats = slim.groupBy("series_id").agg(limit.alias("limit"), F.min_by("y", "ord").alias("y0"))
    chunked = attach_series(slim.withColumn("chunk", chunk_of("ord", chunk_rows)), stats, SERIES)
    moved = written(chunked.select("series_id", "ord", "limit", (F.col("y") - F.col("y0")).alias("y")), "adf")
    lags = moved.agg(F.max("limit")).first()[0] or 0
    columns = ["change", "one", "level", *[f"change_{k}" for k in range(1, lags + 1)]]
    d = len(columns)

    def fit(cells: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        row = (head["series_id"].iloc[0], *_adf_fit(cells, head, d))
        return pd.DataFrame([row], columns=[part.split()[0] for part in ADF_SCHEMA.split(", ")])

    cross = _cross_products(_adf_rows(moved, lags, chunk_rows), columns)
    head = moved.where(F.col("ord") <= F.col("limit"))  # at most limit + 1 rows of a series
    return cross.groupBy("series_id").cogroup(head.groupBy("series_id")).applyInPandas(fit, ADF_SCHEMA)


def _innovations(series: DataFrame, train_share: float, ar_order: int, chunk_rows: int) -> DataFrame:
    """Changes of the series and residuals ``e`` of a long autoregression fitted on the training part.

    Written once: the forecasts and the fit both read it.
    """
    slim = written(series.select("series_id", "ord", F.col("y").cast("double").alias("y")), "series")
    halo = with_halo(slim, "ord", 1, chunk_rows)
    change = F.col("y") - F.lag("y").over(in_chunk(SERIES, "ord"))
    steps = halo.withColumn("dy", change).where("own")
    sizes = slim.groupBy("series_id").agg(F.count("y").alias("n"))
    bounded = written(
        attach_series(steps, sizes.withColumn("n_train", F.floor(F.col("n") * F.lit(train_share)).cast("bigint")), SERIES)
        .select("series_id", "ord", "y", "dy", "n", "n_train"),
        "series",
    )
    training = bounded.where((F.col("ord") > 0) & (F.col("ord") < F.col("n_train")))
    moves = training.select("series_id", (F.col("ord") - 1).alias("ord"), F.col("dy").alias("y"))
    long_ar = _autocorrelations(acf(moves, ar_order, chunk_rows)).select(
        "series_id", _durbin_levinson(F.col("r"), ar_order)["phi"].alias("phi")
    )
    spread = with_halo(bounded, "ord", ar_order + 1, chunk_rows)
    with_phi = attach_series(spread, long_ar, SERIES)
    w = in_chunk(SERIES, "ord")
    fitted = F.lit(0.0)
    for k in range(1, ar_order + 1):
        fitted = fitted + F.col("phi")[k - 1] * F.lag("dy", k).over(w)
    residuals = with_phi.withColumn("e", F.when(F.col("ord") > ar_order, F.col("dy") - fitted))
    lagged = residuals.withColumns({"y1": F.lag("y").over(w), "x": F.lag("dy").over(w), "e1": F.lag("e").over(w)})
    return written(lagged.where("own").drop("own", "phi"), "series")


def _normal_terms(rows: DataFrame) -> DataFrame:
    """Products of the regression of a change on the change and the residual before it; zero where undefined."""
    usable = F.col("dy").isNotNull() & F.col("x").isNotNull() & F.col("e1").isNotNull()
    products = {
        "sxx": F.col("x") * F.col("x"),
        "sxe": F.col("x") * F.col("e1"),
        "see": F.col("e1") * F.col("e1"),
        "sxy": F.col("x") * F.col("dy"),
        "sey": F.col("e1") * F.col("dy"),
    }
    return rows.withColumns({name: F.when(usable, value).otherwise(F.lit(0.0)) for name, value in products.items()})


def _two_by_two() -> tuple[Column, Column]:
    det = F.col("sxx") * F.col("see") - F.col("sxe") * F.col("sxe")
    phi = F.try_divide(F.col("sxy") * F.col("see") - F.col("sey") * F.col("sxe"), det)
    theta = F.try_divide(F.col("sey") * F.col("sxx") - F.col("sxy") * F.col("sxe"), det)
    return phi, theta


NORMAL = ["sxx", "sxe", "see", "sxy", "sey"]


def arima_fit(series: DataFrame, train_share: float = 0.8, ar_order: int = 10, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """ARIMA(1,1,1) on the training part by Hannan-Rissanen: ``(series_id, n_train, phi, theta)``."""
    rows = _normal_terms(_innovations(series, train_share, ar_order, chunk_rows)).where("ord < n_train")
    sums = rows.groupBy("series_id").agg(F.max("n_train").alias("n_train"), *[F.sum(c).alias(c) for c in NORMAL])
    phi, theta = _two_by_two()
    return sums.select("series_id", "n_train", phi.alias("phi"), theta.alias("theta"))


def arima_walk_forward(
    series: DataFrame, train_share: float = 0.8, ar_order: int = 10, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One-step ARIMA(1,1,1) forecasts of the test part, the two coefficients refitted before every step.

    The refit is a 2 x 2 solve on running sums of the history, so the whole walk is one pass. The long autoregression
    that yields the residuals is fitted once, on the training part.
    """
    terms = written(_normal_terms(_innovations(series, train_share, ar_order, chunk_rows)), "series")
    history = running_totals(terms, SERIES, "ord", NORMAL)
    phi, theta = _two_by_two()
    solved = history.withColumns({"phi": phi, "theta": theta}).where("ord >= n_train")
    forecast = F.col("y1") + F.col("phi") * F.col("x") + F.col("theta") * F.col("e1")
    return solved.select("series_id", "ord", "y", "phi", "theta", forecast.alias("forecast"))


def sign_labels(forecasts: DataFrame) -> DataFrame:
    """Classes of actual and forecast: 1 if positive, else 0."""
    return forecasts.select(
        "series_id",
        "ord",
        F.when(F.col("y") > 0, 1).otherwise(0).alias("y"),
        F.when(F.col("forecast") > 0, 1).otherwise(0).alias("yhat"),
    )


def series_of(df: DataFrame, value: str) -> DataFrame:
    """``(series_id, ord, y)`` of one column of a positioned feature table; one series per symbol."""
    return df.select(F.col("symbol").alias("series_id"), "ord", F.col(f"`{value}`").cast("double").alias("y"))
