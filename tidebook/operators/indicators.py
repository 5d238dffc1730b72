"""Technical indicators that are windows over the bars of a session.

Input bars must be complete (``complete_bars``): "n rows" means n surviving bars. Every indicator is
NULL until its window is full.

An indicator family names the windows it needs and the columns made from them. All families together
use one window operator: every distinct window is computed once, and one lag of a struct serves all
columns that look k bars back.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.nulls import exprs, ratio
from tidebook.operators.bars import SESSION, SO_FAR

HIGH, LOW, OPEN, CLOSE, MEAN = (
    "mid_price_high",
    "mid_price_low",
    "mid_price_first",
    "mid_price_last",
    "mid_price_mean",
)

NATIVE = [
    "AROONU_7",
    "AROOND_7",
    *[f"OLL{n}" for n in (3, 5, 10, 15)],
    *[f"OHH{n}" for n in (3, 5)],
    "STOCHk_7_3_3",
    "STOCHd_7_3_3",
    "AO_5_10",
    "HMA_10",
    "MA_10",
    "MA_20",
    *[f"rmCO({n})" for n in (3, 4, 5, 6)],
    "Bollinger_Upper",
    "Bollinger_Lower",
    "U_minus_L",
    "MA20dSTD",
    "CO",
    "C1O1",
    "C2O2",
    "C3O3",
    "range",
    "OH1",
]


LAGGED = f"struct({MEAN} AS mean, {CLOSE} - {OPEN} AS gap, {HIGH} - {OPEN} AS rise, {HIGH} AS high, {LOW} AS low)"


class Family(NamedTuple):
    """Windows by name, and indicator columns over those names."""

    windows: dict[str, str]
    columns: dict[str, str]


def last_rows(n: int) -> str:
    return f"({SESSION} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(agg: str, n: int) -> str:
    return f"{agg} OVER {last_rows(n)}"


def full(n: int, value: str) -> str:
    """``value`` once the session has n bars."""
    return f"CASE WHEN row_nr >= {n} THEN {value} END"


def _before(count: int) -> dict[str, str]:
    return {f"before_{k}": f"lag({LAGGED}, {k}) OVER ({SESSION})" for k in range(1, count + 1)}


def open_extremes() -> Family:
    """Open against the lowest low, and highest high against the open."""
    windows = {f"low_{n}": rolling(f"min({LOW})", n) for n in (3, 5, 10, 15)}
    windows |= {f"high_{n}": rolling(f"max({HIGH})", n) for n in (3, 5)}
    columns = {f"OLL{n}": full(n, f"{OPEN} - low_{n}") for n in (3, 5, 10, 15)}
    columns |= {f"OHH{n}": full(n, f"high_{n} - {OPEN}") for n in (3, 5)}
    return Family(windows, columns)


def close_open() -> Family:
    """Close minus open: rolling means, lags, the bar's range and the lagged high minus open."""
    windows = {f"gap_{n}": rolling(f"avg({CLOSE} - {OPEN})", n) for n in (3, 4, 5, 6)}
    columns = {f"rmCO({n})": full(n, f"gap_{n}") for n in (3, 4, 5, 6)}
    columns |= {"CO": f"{CLOSE} - {OPEN}", **{f"C{k}O{k}": f"before_{k}.gap" for k in (1, 2, 3)}}
    columns |= {"range": f"{HIGH} - {LOW}", "OH1": "before_1.rise"}
    return Family(windows | _before(3), columns)


def moving_averages() -> Family:
    """Simple means, and the linearly weighted mean published under the name ``HMA_10``."""
    weighted = " + ".join([f"{MEAN} * 10", *[f"before_{k}.mean * {10 - k}" for k in range(1, 10)]])
    windows = {f"mean_{n}": rolling(f"avg({MEAN})", n) for n in (10, 20)}
    columns = {f"MA_{n}": full(n, f"mean_{n}") for n in (10, 20)}
    return Family(windows | _before(9), columns | {"HMA_10": f"({weighted}) / 55D"})


def bollinger() -> Family:
    """20-bar mean plus and minus two population deviations, and the close's sample deviation."""
    windows = {
        "mean_20": rolling(f"avg({MEAN})", 20),
        "spread_20": rolling(f"stddev_pop({MEAN})", 20),
        "close_spread_20": rolling(f"stddev_samp({CLOSE})", 20),
    }
    columns = {
        "Bollinger_Upper": "mean_20 + 2D * spread_20",
        "Bollinger_Lower": "mean_20 - 2D * spread_20",
        "U_minus_L": "4D * spread_20",
        "MA20dSTD": "close_spread_20",
    }
    return Family(windows, {name: full(20, value) for name, value in columns.items()})


def aroon(n: int = 7, ties: str = "latest") -> Family:
    """Bars since the extreme of the last n+1 bars, as a percentage; ``ties`` names the winning bar."""
    if ties not in ("latest", "earliest"):
        raise ValueError(f"ties {ties!r}: expected 'latest' or 'earliest'")
    ages = range(n + 1) if ties == "latest" else range(n, -1, -1)

    def percent(now: str, field: str, extreme: str) -> str:
        values = {k: f"before_{k}.{field}" if k else now for k in ages}
        age = " ".join(f"WHEN {value} = {extreme} THEN {k}" for k, value in values.items())
        return full(n + 1, f"100D * ({n} - CASE {age} END) / {n}D")

    windows = {f"high_{n + 1}": rolling(f"max({HIGH})", n + 1), f"low_{n + 1}": rolling(f"min({LOW})", n + 1)}
    columns = {f"AROONU_{n}": percent(HIGH, "high", f"high_{n + 1}"), f"AROOND_{n}": percent(LOW, "low", f"low_{n + 1}")}
    return Family(windows | _before(n), columns)


def awesome() -> Family:
    """Short minus long mean of the bar's middle."""
    windows = {f"middle_{n}": rolling(f"avg(({HIGH} + {LOW}) / 2)", n) for n in (5, 10)}
    return Family(windows, {"AO_5_10": full(10, "middle_5 - middle_10")})


def stochastic() -> Family:
    """%K before it is carried over bars with a zero range; ``carried_stochastic`` makes the output columns."""
    windows = {"high_7": rolling(f"max({HIGH})", 7), "low_7": rolling(f"min({LOW})", 7)}
    return Family(windows, {"raw_k": full(7, ratio(f"({CLOSE} - low_7) * 100", "high_7 - low_7"))})


def with_families(bars: DataFrame, *families: Family) -> DataFrame:
    """Add the columns of the families and ``row_nr``, the bar's position in its session from 1."""
    windows = {"row_nr": f"row_number() OVER ({SESSION})"}
    columns: dict[str, str] = {}
    for family in families:
        windows |= family.windows
        columns |= family.columns
    scratch = [name for name in windows if name != "row_nr"]
    return bars.withColumns(exprs(windows)).withColumns(exprs(columns)).drop(*scratch)


def carried_stochastic(with_raw: DataFrame, smooth: int = 3) -> DataFrame:
    """Stochastic %K and its mean %D, both carried forward over bars with a zero range."""
    frame = last_rows(smooth)
    steady = f"CASE WHEN count(raw_k) OVER {frame} = {smooth} THEN avg(raw_k) OVER {frame} END"
    carried = {"STOCHk_7_3_3": "raw_k", "STOCHd_7_3_3": "raw_d"}
    smoothed = with_raw.withColumn("raw_d", F.expr(steady))
    out = {name: f"last({raw}) IGNORE NULLS OVER {SO_FAR}" for name, raw in carried.items()}
    return smoothed.withColumns(exprs(out)).drop("raw_k", "raw_d")


def native_indicators(bars: DataFrame, ties: str = "latest") -> DataFrame:
    """All window indicators; keeps ``row_nr``."""
    families = [open_extremes(), close_open(), moving_averages(), bollinger(), aroon(ties=ties), awesome(), stochastic()]
    return carried_stochastic(with_families(bars, *families))
