import numpy as np
import pytest

from tidebook.operators import series


def frame(spark, **named):
    rows = [(sid, i, float(v)) for sid, y in named.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id STRING, ord BIGINT, y DOUBLE").repartition(7)


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=n)


def ar1(n, phi, seed=0):
    e, y = noise(n, seed), np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + e[t]
    return y


def acf_by_hand(y, lags):
    d = y - y.mean()
    return np.array([(d[k:] * d[: len(d) - k]).sum() / (d * d).sum() for k in range(lags + 1)])


def by_lag(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["series_id"], {})[r["lag"]] = r[column]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("chunk_rows", [25, 97, 65_536])
def test_acf(spark, chunk_rows):
    a, b = 1e6 + ar1(500, 0.7), noise(60, 3)
    got = by_lag(series.acf(frame(spark, a=a, b=b), 20, chunk_rows), "acf")
    assert got["a"] == pytest.approx(acf_by_hand(a, 20), abs=1e-8)
    assert got["b"] == pytest.approx(acf_by_hand(b, 20), abs=1e-10)


def test_pacf_solves_the_yule_walker_equations(spark):
    a = ar1(600, 0.6, 5)
    got = by_lag(series.pacf(frame(spark, a=a), 8, 100), "pacf")["a"]
    r = acf_by_hand(a, 8)
    want = [1.0]
    for k in range(1, 9):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(system, r[1 : k + 1])[-1])
    assert got == pytest.approx(want, abs=1e-9)


def adf_by_hand(y, limit):
    dy = np.diff(y)

    def ols(lag, start):
        rows = range(start, len(dy))
        x = np.array([[1.0, y[t], *[dy[t - k] for k in range(1, lag + 1)]] for t in rows])
        target = dy[start:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        ssr = ((target - x @ beta) ** 2).sum()
        n, k = x.shape
        se = np.sqrt(ssr / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
        return n * np.log(ssr / n) + 2 * k, beta[1] / se, n

    best = min((ols(lag, limit)[0], lag) for lag in range(limit + 1))[1]
    _, stat, n = ols(best, best)
    return stat, best, n


@pytest.mark.parametrize("chunk_rows", [64, 65_536])
def test_adf(spark, chunk_rows):
    walk, white, short = np.cumsum(noise(400, 1)), noise(400, 2), ar1(90, 0.5, 4)
    got = {r["series_id"]: r for r in series.adf(frame(spark, walk=walk, white=white, short=short), chunk_rows=chunk_rows).collect()}
    for name, y in (("walk", walk), ("white", white), ("short", short)):
        limit = min(len(y) // 2 - 2, int(np.ceil(12 * (len(y) / 100) ** 0.25)))
        stat, lag, n = adf_by_hand(y, limit)
        assert (got[name]["used_lag"], got[name]["nobs"]) == (lag, n)
        assert got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
    assert got["white"]["stationary"] and not got["walk"]["stationary"]
    assert got["white"]["critical_5"] == pytest.approx(-2.86, abs=0.02)


def test_adf_of_a_constant(spark):
    got = series.adf(frame(spark, flat=np.ones(50))).first()
    assert got["statistic"] is None and got["stationary"] is False


def test_p_values_at_known_points():
    assert series.mackinnon_p(-2.8615) == pytest.approx(0.05, abs=2e-3)
    assert series.mackinnon_p(-3.4304) == pytest.approx(0.01, abs=1e-3)
    assert series.mackinnon_p(5) == 1.0 and series.mackinnon_p(-30) == 0.0


def arma_changes(n, phi, theta, seed):
    e, d = noise(n, seed), np.zeros(n)
    for t in range(1, n):
        d[t] = phi * d[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(d)


def test_arima_recovers_coefficients(spark):
    y = arma_changes(20_000, 0.5, 0.3, 8)
    got = series.arima_fit(frame(spark, s=y), ar_order=20, chunk_rows=3000).first()
    assert got["phi"] == pytest.approx(0.5, abs=0.05) and got["theta"] == pytest.approx(0.3, abs=0.05)


@pytest.mark.parametrize("chunk_rows", [30, 65_536])
def test_walk_forward_refits_at_every_step(spark, chunk_rows):
    y, order = arma_changes(200, 0.4, 0.2, 9), 4
    got = {r["ord"]: r for r in series.arima_walk_forward(frame(spark, s=y), 0.8, order, chunk_rows).collect()}
    train, dy = int(200 * 0.8), np.diff(y)
    r = acf_by_hand(dy[: train - 1], order)
    long_ar = np.linalg.solve([[r[abs(i - j)] for j in range(order)] for i in range(order)], r[1:])
    e = {t: dy[t] - sum(long_ar[k] * dy[t - 1 - k] for k in range(order)) for t in range(order, len(dy))}
    assert sorted(got) == list(range(train, 200))
    for t in (train, train + 7, 199):
        past = [s for s in range(order + 1, t - 1)]  # changes known before step t
        x = np.array([[dy[s - 1], e[s - 1]] for s in past])
        phi, theta = np.linalg.lstsq(x, dy[past], rcond=None)[0]
        forecast = y[t - 1] + phi * dy[t - 2] + theta * e[t - 2]
        assert (got[t]["phi"], got[t]["theta"], got[t]["forecast"]) == pytest.approx((phi, theta, forecast), rel=1e-6)


def test_sign_labels(spark):
    df = spark.createDataFrame([("s", 0, 1.0, -1.0), ("s", 1, 0.0, 2.0)], "series_id STRING, ord BIGINT, y DOUBLE, forecast DOUBLE")
    assert [tuple(r)[2:] for r in series.sign_labels(df).orderBy("ord").collect()] == [(1, 0), (0, 1)]
