"""Indicators whose value depends on their own previous value, as affine scans.

Each of them is ``y[t] = gain[t] * y[t-1] + add[t]`` with a gain and an addend that a bar knows by itself and a few
bars before it; window functions bring those along. Affine steps compose, so a stretch of bars is solved without a
loop over bars by doubling: log2(n) vector operations give, for each bar, what the whole stretch before it makes of
its opening value. There are two levels: means and directional sums first, then what is recursive on those.

A session of at most ``block_rows`` bars is one group of one Arrow pass. Longer sessions are cut into blocks of
``block_rows``: every block is solved on its own, the blocks' end results, one small row each, are composed in order,
and each block adds what its opening value contributes. No group holds more than ``block_rows`` bars, and a session
is no task of its own. Columns the pass does not need travel in one struct, untouched.

Warm-up: an exponential mean seeds on its first value and is NULL for the first n-1 rows; Wilder sums
seed on the plain sum of the first n moves; the gain and loss means of RSI seed on zero at the first
bar and RSI is 100 without losses; KAMA seeds on row n; DX is 0 when both directions are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.session import written

RECURSIVE = [
    "ADX_5",
    "ADX_7",
    "ADX_10",
    "DMP_5",
    "DMP_10",
    "DMN_5",
    "DMN_10",
    "MACD_8_21_5",
    "RSI_7",
    "EMA_15",
    "KAMA_3_2_10",
]
PRICES = ["mid_price_high", "mid_price_low", "mid_price_last", "mid_price_mean"]
KEYS = ["symbol", "session", "bar_ix"]
GROUP = ["symbol", "session"]
#: What a bar needs of the bars before it, by the names the steps use.
NEAR = {
    "nr": "row_number() OVER w",
    "high_1": "lag(mid_price_high) OVER w",
    "low_1": "lag(mid_price_low) OVER w",
    "last_1": "lag(mid_price_last) OVER w",
    "mean_1": "lag(mid_price_mean) OVER w",
    "mean_2": "lag(mid_price_mean, 2) OVER w",
    "mean_3": "lag(mid_price_mean, 3) OVER w",
}
WIDTHS = (5, 7, 10)
RSI, SIGNAL, SLOW, KAMA = 7, 5, 21, 3
BLOCK_ROWS = 65_536

Steps = dict[str, tuple[np.ndarray, np.ndarray]]
Columns = dict[str, np.ndarray]


def scan(gain: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed steps: for the rows up to each one, the gain on the opening value and what is added to it."""
    gain, add = gain.copy(), add.copy()
    reach = 1
    while reach < len(add):
        add[reach:] += gain[reach:] * add[:-reach]
        gain[reach:] = gain[reach:] * gain[:-reach]
        reach *= 2
    return gain, add


def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, 0 where y is 0."""
    still = y == 0.0
    return np.where(still, 0.0, x / np.where(still, 1.0, y))


def first_steps(c: Columns) -> Steps:
    """Means, gains and losses, the adaptive mean and the directional sums."""
    nr, mean, later = c["nr"], c["mid_price_mean"], c["nr"] > 1
    steps: Steps = {}
    for n in (8, SLOW, 15):
        weight = 2.0 / (n + 1)
        steps[f"ema{n}"] = np.where(later, 1 - weight, 0.0), np.where(later, weight * mean, mean)
    change = np.where(later, mean - c["mean_1"], 0.0)
    for name, side in (("gain", change), ("loss", -change)):
        steps[name] = np.full(len(nr), 1 - 1 / RSI), np.maximum(side, 0.0) / RSI
    ready = nr > KAMA
    path = np.abs(mean - c["mean_1"]) + np.abs(c["mean_1"] - c["mean_2"]) + np.abs(c["mean_2"] - c["mean_3"])
    efficiency = ratio(np.where(ready, np.abs(mean - c["mean_3"]), 0.0), np.where(ready, path, 0.0))
    quick, calm = 2.0 / 3, 2.0 / 11
    rate = (efficiency * (quick - calm) + calm) ** 2
    steps["kama"] = np.where(ready, 1 - rate, 0.0), np.where(ready, rate * mean, np.where(nr == KAMA, mean, 0.0))
    up, down = c["mid_price_high"] - c["high_1"], c["low_1"] - c["mid_price_low"]
    moves = {
        "range": np.maximum(c["mid_price_high"], c["last_1"]) - np.minimum(c["mid_price_low"], c["last_1"]),
        "up": np.where((up > down) & (up > 0), up, 0.0),
        "down": np.where((down > up) & (down > 0), down, 0.0),
    }
    for n in WIDTHS:
        for name, move in moves.items():
            steps[f"{name}{n}"] = np.where(nr <= n + 1, 1.0, 1 - 1 / n), np.where(later, move, 0.0)
    return steps


def directions(y: Columns, n: int) -> tuple[np.ndarray, np.ndarray]:
    """+DI and -DI."""
    return ratio(100.0 * y[f"up{n}"], y[f"range{n}"]), ratio(100.0 * y[f"down{n}"], y[f"range{n}"])


def second_steps(c: Columns, y: Columns) -> Steps:
    """The signal line, and the means of the directional indices."""
    nr, line, weight = c["nr"], y["ema8"] - y[f"ema{SLOW}"], 2.0 / (SIGNAL + 1)
    steps = {"signal": (np.where(nr > SLOW, 1 - weight, 0.0), np.where(nr > SLOW, weight * line, np.where(nr == SLOW, line, 0.0)))}
    for n in WIDTHS:
        rise, fall = directions(y, n)
        index = 100.0 * ratio(np.abs(rise - fall), rise + fall)
        steps[f"adx{n}"] = np.where(nr <= n, 0.0, np.where(nr <= 2 * n, 1.0, 1 - 1 / n)), np.where(nr > n, index / n, 0.0)
    return steps


def indicator_columns(c: Columns, y: Columns) -> Columns:
    """All indicators of bars from the values of both levels; NaN while they warm up."""
    nr, out = c["nr"], {}

    def after(row: int, values: np.ndarray) -> np.ndarray:
        return np.where(nr >= row, values, np.nan)

    for n in WIDTHS:
        out[f"ADX_{n}"] = after(2 * n, y[f"adx{n}"])
        out[f"DMP_{n}"], out[f"DMN_{n}"] = (after(n + 1, x) for x in directions(y, n))
    out["MACD_8_21_5"] = after(SLOW + SIGNAL - 1, y["ema8"] - y[f"ema{SLOW}"] - y["signal"])
    still = y["loss"] == 0.0
    out["RSI_7"] = after(RSI, np.where(still, 100.0, 100.0 - 100.0 / (1.0 + ratio(y["gain"], y["loss"]))))
    out["EMA_15"], out["KAMA_3_2_10"] = after(15, y["ema15"]), after(KAMA, y["kama"])
    return {name: out[name] for name in RECURSIVE}


def composed(steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    return scan(*[np.stack([pair[side] for pair in steps.values()], 1) for side in (0, 1)])


def _columns(table: pa.Table | pa.RecordBatch) -> Columns:
    return {name: table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False) for name in [*PRICES, *NEAR]}


def _with(table: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    for name, values in columns.items():
        table = table.append_column(name, values)
    return table


def _nullable(columns: Columns) -> dict[str, pa.Array]:
    return {name: pa.array(values, from_pandas=True) for name, values in columns.items()}


def _matrix(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _rows(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(rows, -1)


def _near(prices: Columns) -> Columns:
    """The columns of ``NEAR`` of a whole session."""
    size = len(prices["mid_price_mean"])

    def back(name: str, n: int) -> np.ndarray:
        return np.concatenate([np.full(min(n, size), np.nan), prices[f"mid_price_{name}"][: max(0, size - n)]])

    lags = {name: back(*name.split("_")[:1], int(name.split("_")[1])) for name in NEAR if name != "nr"}
    return prices | {"nr": np.arange(1, size + 1)} | lags


def _session_pass(table: pa.Table) -> pa.Table:
    ordered = table.sort_by("bar_ix")
    c = _near({name: ordered.column(name).to_numpy() for name in PRICES})
    y: Columns = {}
    for steps in (first_steps, lambda c: second_steps(c, y)):
        found = steps(c)
        y |= dict(zip(found, composed(found)[1].T))
    return _with(ordered, _nullable(indicator_columns(c, y)))


def _in_blocks(df: DataFrame, level: Callable[[Columns, pa.Table], Steps]) -> DataFrame:
    """Adds each row's composed steps of its block, ``gains`` and ``adds``."""

    def solved(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("bar_ix")
        gains, adds = composed(level(_columns(ordered), ordered))
        return _with(ordered, {"gains": _matrix(gains), "adds": _matrix(adds)})

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("gains", "adds")]])
    return df.groupBy(*GROUP, "block").applyInArrow(solved, schema)


def _opened(solved: DataFrame) -> DataFrame:
    """Adds ``open``, the values that each block begins with: the blocks before it, composed in order."""

    def carried(ends: pa.Table) -> pa.Table:
        ordered = ends.sort_by("block")
        gains, adds = (_rows(ordered.column(c), len(ordered)) for c in ("gains", "adds"))
        opening, now = np.zeros_like(adds), np.zeros(adds.shape[1])
        for i in range(len(adds)):
            opening[i] = now
            now = gains[i] * now + adds[i]
        return _with(ordered.select([*GROUP, "block"]), {"open": _matrix(opening)})

    ends = solved.groupBy(*GROUP, "block").agg(F.max_by(F.struct("gains", "adds"), "nr").alias("end")).select(*GROUP, "block", "end.gains", "end.adds")
    schema = T.StructType([*[solved.schema[c] for c in (*GROUP, "block")], T.StructField("open", T.ArrayType(T.DoubleType()))])
    return solved.join(ends.groupBy(*GROUP).applyInArrow(carried, schema), [*GROUP, "block"]).select(*solved.columns, "open")


def _values(table: pa.Table | pa.RecordBatch, names: list[str]) -> Columns:
    gains, adds, opening = (_rows(table.column(c), table.num_rows) for c in ("gains", "adds", "open"))
    return dict(zip(names, (adds + gains * opening).T))


def _by_blocks(packed: DataFrame, block_rows: int) -> DataFrame:
    """The two levels, each solved in blocks that are then opened."""
    blocks = packed.withColumn("block", F.expr(f"(nr - 1) DIV {block_rows}"))
    first = written(_in_blocks(blocks, lambda c, _: first_steps(c)), "scan-first")
    none = {name: np.ones(1) for name in [*PRICES, *NEAR]}
    names = list(first_steps(none))

    # The values of the first level stay with their row while the second is solved.
    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.stack(list(_values(batch, names).values()), 1)
                kept = [c for c in batch.schema.names if c not in ("gains", "adds", "open")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _matrix(values)], [*kept, "first"])

    schema = T.StructType([*blocks.schema.fields, T.StructField("first", T.ArrayType(T.DoubleType()))])
    opened = _opened(first).mapInArrow(valued, schema)

    def known(table: pa.Table | pa.RecordBatch) -> Columns:
        return dict(zip(names, _rows(table.column("first"), table.num_rows).T))

    second = written(_in_blocks(opened, lambda c, table: second_steps(c, known(table))), "scan-second")
    more, bars = list(second_steps(none, dict.fromkeys(names, np.ones(1)))), packed.columns

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _nullable(indicator_columns(_columns(batch), known(batch) | _values(batch, more)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in bars], *found.values()], [*bars, *found])

    return _opened(second).mapInArrow(shown, _with_indicators(packed))


def _with_indicators(packed: DataFrame) -> T.StructType:
    return T.StructType([*packed.schema.fields, *[T.StructField(c, T.DoubleType()) for c in RECURSIVE]])


def recursive_indicators(bars: DataFrame, session_bars: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add every recursive indicator to complete bars.

    ``session_bars`` is the most bars a session can have, if known: up to ``block_rows`` one pass does.
    """
    others = [c for c in bars.columns if c not in {*KEYS, *PRICES}]
    near = [f"{e.replace(' w', ' (PARTITION BY symbol, session ORDER BY bar_ix)')} AS {name}" for name, e in NEAR.items()]
    rest = [f"struct({', '.join(f'`{c}`' for c in others)}) AS others"] if others else []
    if session_bars is not None and session_bars <= block_rows:
        packed = bars.selectExpr(*KEYS, *PRICES, *rest)
        done = packed.groupBy(*GROUP).applyInArrow(_session_pass, _with_indicators(packed))
    else:
        done = _by_blocks(bars.selectExpr(*KEYS, *PRICES, *near, *rest), block_rows)
    return done.selectExpr(*[f"others.`{c}`" if c in others else f"`{c}`" for c in bars.columns], *RECURSIVE)
