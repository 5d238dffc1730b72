import math
import random

import numpy as np
import pytest

from tidebook.functions.nulls import all_present
from tidebook.operators.indicators import aroon, native_indicators, with_families
from tidebook.operators.recursive import RECURSIVE, recursive_indicators, scan
from tidebook.plans.feature_table import INDICATORS, indicators

SCHEMA = (
    "symbol STRING, session STRING, bar_ix BIGINT, mid_price_first DOUBLE, mid_price_last DOUBLE, mid_price_high DOUBLE, "
    "mid_price_low DOUBLE, mid_price_mean DOUBLE"
)


def random_bars(seed, n, flat=0.0):
    rng, rows, price = random.Random(seed), [], 100.0
    for i in range(n):
        first = price
        last = first if rng.random() < flat else first + rng.choice([-3, -1, 0, 1, 2]) / 64
        high, low = max(first, last) + rng.randint(0, 2) / 64, min(first, last) - rng.randint(0, 2) / 64
        rows.append(("X", "d", i * 2, first, last, high, low, (first + last + high + low) / 4))
        price = last
    return rows


def collected(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["symbol"], r["session"], r["bar_ix"]))


def by_hand(rows):
    """RSI, EMA, MACD, KAMA and directional movement, step by step."""
    h, lo, c, m = ([r[k] for r in rows] for k in (5, 6, 4, 7))
    n = len(rows)
    out = {name: [None] * n for name in RECURSIVE}

    def smooth(values, alpha, start=0):
        y, res = None, [None] * len(values)
        for i in range(start, len(values)):
            y = values[i] if y is None else y + alpha * (values[i] - y)
            res[i] = y
        return res

    out["EMA_15"] = [v if i >= 14 else None for i, v in enumerate(smooth(m, 2 / 16))]
    line = [a - b for a, b in zip(smooth(m, 2 / 9), smooth(m, 2 / 22))]
    signal = smooth(line, 2 / 6, start=20)
    out["MACD_8_21_5"] = [line[i] - signal[i] if i >= 24 else None for i in range(n)]
    step = [0.0] + [b - a for a, b in zip(m, m[1:])]
    up, down = smooth([max(s, 0) for s in step], 1 / 7), smooth([max(-s, 0) for s in step], 1 / 7)
    out["RSI_7"] = [None if i < 6 else 100.0 if down[i] == 0 else 100 - 100 / (1 + up[i] / down[i]) for i in range(n)]
    for i in range(2, n):
        if i == 2:
            k = m[2]
        else:
            path = sum(abs(m[j] - m[j - 1]) for j in (i, i - 1, i - 2))
            er = abs(m[i] - m[i - 3]) / path if path else 0.0
            k += (er * (2 / 3 - 2 / 11) + 2 / 11) ** 2 * (m[i] - k)
        out["KAMA_3_2_10"][i] = k
    tr = [None] + [max(h[i], c[i - 1]) - min(lo[i], c[i - 1]) for i in range(1, n)]
    plus, minus = [None] * n, [None] * n
    for i in range(1, n):
        a, b = h[i] - h[i - 1], lo[i - 1] - lo[i]
        plus[i], minus[i] = (a if a > b and a > 0 else 0.0), (b if b > a and b > 0 else 0.0)
    for w in (5, 7, 10):
        sums, dx, adx = None, [None] * n, None
        for i in range(w, n):
            sums = [sum(x[1 : w + 1]) if i == w else s - s / w + x[i] for x, s in zip((tr, plus, minus), sums or (0, 0, 0))]
            pdi, mdi = (100 * s / sums[0] if sums[0] else 0.0 for s in sums[1:])
            if w != 7:
                out[f"DMP_{w}"][i], out[f"DMN_{w}"][i] = pdi, mdi
            dx[i] = 100 * abs(pdi - mdi) / (pdi + mdi) if pdi + mdi else 0.0
            if i == 2 * w - 1:
                adx = sum(dx[w : 2 * w]) / w
            elif i >= 2 * w:
                adx = (adx * (w - 1) + dx[i]) / w
            out[f"ADX_{w}"][i] = adx
    return out


@pytest.mark.parametrize("size", [{"session_bars": 100}, {}, {"block_rows": 7}, {"block_rows": 1}])
@pytest.mark.parametrize("n, flat", [(60, 0.2), (4, 0.0), (26, 0.9)])
def test_recursive_indicators(spark, n, flat, size):
    rows = random_bars(5, n, flat)
    got = collected(recursive_indicators(spark.createDataFrame(rows, SCHEMA), **size))
    want = by_hand(rows)
    for name in RECURSIVE:
        assert [r[name] for r in got] == [None if v is None else pytest.approx(v, abs=1e-9) for v in want[name]], name


@pytest.mark.parametrize("size", [{"session_bars": 100}, {"block_rows": 7}])
def test_constant_prices(spark, size):
    rows = [("X", "d", i, 100.0, 100.0, 100.0, 100.0, 100.0) for i in range(40)]
    got = collected(recursive_indicators(spark.createDataFrame(rows, SCHEMA), **size))
    assert {r["RSI_7"] for r in got[6:]} == {100.0} and {r["ADX_10"] for r in got[19:]} == {0.0}
    assert [r["KAMA_3_2_10"] for r in got[2:]] == pytest.approx([100.0] * 38) and all(r["KAMA_3_2_10"] is None for r in got[:2])


def test_scan_composes_steps():
    rng = np.random.default_rng(0)
    gain, add = rng.random((53, 2)), rng.normal(size=(53, 2))
    gain[20] = 0
    y, want = np.array([3.0, -1.0]), []
    for g, a in zip(gain, add):
        y = g * y + a
        want.append(y)
    gains, adds = scan(gain, add)
    assert np.allclose(adds + gains * np.array([3.0, -1.0]), want)


def test_blocks_are_the_groups_of_a_long_session(spark):
    bars = spark.createDataFrame(random_bars(5, 40), SCHEMA)
    grouped = []
    groups = type(bars).groupBy
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(bars), "groupBy", lambda self, *keys: grouped.append(keys) or groups(self, *keys))
        recursive_indicators(bars, block_rows=7)
    # Whole sessions are only grouped on one row per block.
    assert grouped.count(("symbol", "session", "block")) == 4 and grouped.count(("symbol", "session")) == 2


def test_window_indicators_wait_for_a_full_window(spark):
    got = collected(native_indicators(spark.createDataFrame(random_bars(1, 30), SCHEMA)))
    for name, warm in {"OLL15": 14, "MA_20": 19, "HMA_10": 9, "AO_5_10": 9, "AROONU_7": 7, "rmCO(6)": 5, "C3O3": 3}.items():
        assert [r[name] is None for r in got] == [i < warm for i in range(30)], name


def test_aroon_ties(spark):
    rows = [("X", "d", i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(9)]
    bars = spark.createDataFrame(rows, SCHEMA)
    for ties, value in (("latest", 100.0), ("earliest", 0.0)):
        last = collected(with_families(bars, aroon(ties=ties)))[-1]
        assert (last["AROONU_7"], last["AROOND_7"]) == (value, value)


def test_stochastic_is_carried_over_flat_stretches(spark):
    rows = random_bars(2, 10) + [("X", "d", 100 + i, 100.0, 100.0, 100.0, 100.0, 100.0) for i in range(12)]
    got = collected(native_indicators(spark.createDataFrame(rows, SCHEMA)))
    assert got[-1]["STOCHk_7_3_3"] == got[-4]["STOCHk_7_3_3"] is not None
    assert got[-1]["STOCHd_7_3_3"] is not None


def test_last_warm_ups_imply_all_indicators(spark):
    bars = spark.createDataFrame(random_bars(3, 60, 0.5), SCHEMA)
    every = recursive_indicators(native_indicators(bars)).where(all_present(INDICATORS))
    assert [r["bar_ix"] for r in collected(every)] == [r["bar_ix"] for r in collected(indicators(bars))]
    assert not any(math.isnan(r["ADX_10"]) for r in every.collect())


def test_sessions_do_not_mix(spark):
    rows = random_bars(4, 40)
    twice = rows + [("X", "e", *r[2:]) for r in rows]
    got = collected(indicators(spark.createDataFrame(twice, SCHEMA)))
    half = len(got) // 2
    assert [r["EMA_15"] for r in got[:half]] == [r["EMA_15"] for r in got[half:]]
