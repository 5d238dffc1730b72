"""Model datasets: positions, chronological splits, scalers and look-back sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.chunks import CHUNK_ROWS, in_chunk, with_halo

# Named feature sets.
FEATURE_SETS: dict[str, list[str]] = {
    "trend": [
        "ADX_5",
        "ADX_7",
        "ADX_10",
        "DMP_5",
        "DMP_10",
        "DMN_5",
        "DMN_10",
        "AROONU_7",
        "AROOND_7",
        "OLL3",
        "OLL5",
        "OLL10",
        "OLL15",
        "OHH3",
        "OHH5",
    ],
    "oscillators": ["STOCHk_7_3_3", "STOCHd_7_3_3", "MACD_8_21_5", "RSI_7", "AO_5_10"],
    "moving_averages": [
        "EMA_15",
        "HMA_10",
        "KAMA_3_2_10",
        "MA_10",
        "MA_20",
        "rmCO(3)",
        "rmCO(4)",
        "rmCO(5)",
        "rmCO(6)",
    ],
    "volatility": ["Bollinger_Upper", "Bollinger_Lower", "U_minus_L", "MA20dSTD"],
    "other": ["CO", "C1O1", "C2O2", "C3O3", "range", "OH1"],
    "mid_price": [
        "mid_price_mean",
        "std_mid_price",
        "weighted_mid_price_first",
        "weighted_mid_price_mean",
        "weighted_mid_price_last",
        "mid_price_variation",
        "weighted_mid_price_variation",
    ],
    "bid_ask_prices": [
        "last_best_bid_price",
        "mean_best_bid_price",
        "last_best_ask_price",
        "mean_best_ask_price",
        "bid_price_variation",
        "ask_price_variation",
        "last_spread",
        "mean_spread",
        "std_spread",
        "mean_second_ask_price",
        "mean_second_bid_price",
    ],
    "volume": [
        "last_best_bid_size",
        "mean_best_bid_size",
        "std_best_bid_size",
        "last_best_ask_size",
        "mean_best_ask_size",
        "std_best_ask_size",
        "bid_volume_variation",
        "ask_volume_variation",
        "total_bid_volume",
        "total_ask_volume",
    ],
    "orders": [
        "total_net_order_flow",
        "num_added_orders",
        "mean_order_book_imbalance",
        "last_order_book_imbalance",
        "order_book_imbalance_5s",
        "order_flow_5s",
        "num_canceled_orders",
        "num_traded_orders",
    ],
    "ohlc": ["trade_open", "trade_close", "trade_high", "trade_low"],
    "classifier": [
        "std_mid_price",
        "weighted_mid_price_variation",
        "mean_mid_price_variation",
        "std_spread",
        "mean_spread",
        "total_bid_volume",
        "total_ask_volume",
        "std_best_bid_size",
        "std_best_ask_size",
        "mean_order_book_imbalance",
        "order_book_imbalance_5s",
        "order_flow_5s",
        "last_order_book_imbalance",
        "total_net_order_flow",
        "time_since_open",
    ],
    "regression_standard": [
        "DMP_5",
        "DMP_10",
        "DMN_5",
        "DMN_10",
        "MACD_8_21_5",
        "AO_5_10",
        "EMA_15",
        "MA_20",
        "KAMA_3_2_10",
        "CO",
        "C2O2",
        "C3O3",
        "total_ask_volume",
        "total_bid_volume",
        "Bollinger_Upper",
        "Bollinger_Lower",
        "mid_price_variation",
        "std_mid_price",
    ],
    "regression_minmax": ["ADX_10", "ADX_7", "ADX_5", "STOCHk_7_3_3", "STOCHd_7_3_3", "RSI_7", "time_since_open"],
    "regression_plain": ["market_session"],
    "classifier_technical": [
        "DMN_5",
        "DMN_10",
        "ADX_5",
        "ADX_10",
        "DMP_5",
        "MACD_8_21_5",
        "STOCHd_7_3_3",
        "RSI_7",
        "MA_20",
        "KAMA_3_2_10",
        "EMA_15",
        "MA_10",
        "Bollinger_Lower",
        "Bollinger_Upper",
    ],
}
FEATURE_SETS["technical"] = [
    c for s in ("trend", "oscillators", "moving_averages", "volatility", "other") for c in FEATURE_SETS[s]
]
FEATURE_SETS["order_book"] = [
    *[c for s in ("mid_price", "bid_ask_prices", "volume", "orders") for c in FEATURE_SETS[s]],
    "mean_mid_price_variation",
]

SHARES: dict[str, float] = {"train": 0.7, "val": 0.1, "test": 0.2}


def with_positions(df: DataFrame, order: str = "bar_ix") -> DataFrame:
    """Add ``ord``, the row's position in its symbol's history from 0, and ``n_rows`` of that symbol.

    Positions inside a session come from the session window; a running total of one row per session
    supplies the offset. ``df`` is read twice; hand in a written table.
    """
    counts = df.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("rows"))
    history = Window.partitionBy("symbol").orderBy("session")
    offsets = counts.select(
        "symbol",
        "session",
        (F.sum("rows").over(history.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("start"),
        F.sum("rows").over(history.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    place = F.row_number().over(Window.partitionBy("symbol", "session").orderBy(order)) - 1
    return (
        df.withColumn("place", place)
        .join(offsets, ["symbol", "session"])
        .withColumn("ord", F.col("start") + F.col("place"))
        .drop("place", "start")
    )


def chronological_split(positioned: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """Add ``split`` and ``split_ord``; all sizes but the last are cut down to whole rows."""
    names = list(shares)
    bounds = [F.lit(0).cast("bigint")]
    for name in names[:-1]:
        bounds.append(bounds[-1] + F.floor(F.col("n_rows") * F.lit(float(shares[name]))).cast("bigint"))
    split, start = F.lit(names[0]), bounds[0]
    for name, bound in zip(names[1:], bounds[1:]):
        past = F.col("ord") >= bound
        split, start = F.when(past, F.lit(name)).otherwise(split), F.when(past, bound).otherwise(start)
    return positioned.withColumns({"split": split, "split_ord": F.col("ord") - start})


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """``{column: (center, scale)}`` from one aggregate; a constant column gets scale 1.

    ``standard`` uses the mean and population deviation, ``minmax`` the minimum and the range. The result
    has two numbers per column, whatever the size of ``train``.
    """
    pairs = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
    aggs = [
        f(F.col(f"`{c}`").cast("double")).alias(f"{part}_{i}")
        for i, c in enumerate(columns)
        for part, f in zip(("center", "scale"), pairs)
    ]
    row = train.agg(*aggs).first()

    def usable(center: float | None, scale: float | None) -> float:
        """1 for a constant column: merged partial moments may leave a rest of rounding errors."""
        return scale if scale is not None and scale > 1e-12 * abs(center or 0.0) else 1.0

    return {c: (row[f"center_{i}"], usable(row[f"center_{i}"], row[f"scale_{i}"])) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Apply a fitted scaler to any frame."""
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def unscale(df: DataFrame, scaler: Mapping[str, tuple[float, float]], columns: Mapping[str, str]) -> DataFrame:
    """Undo scaling; ``columns`` maps a prediction column to the scaled column it predicts."""
    undone = {c: F.col(f"`{c}`") * F.lit(scaler[of][1]) + F.lit(scaler[of][0]) for c, of in columns.items()}
    return df.withColumns(undone)


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str | Sequence[str],
    look_back: int,
    scale: str | None = "window",
    keys: Sequence[str] = ("symbol", "split"),
    ord_col: str = "split_ord",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per sequence: ``keys``, ``ord_col`` of its label row, ``x`` and the targets.

    ``x`` holds the ``look_back`` rows before the label row. With ``scale="window"`` every feature of
    every sequence is mapped to [0, 1] on its own; a constant one becomes 0. Several targets are kept
    under their own names, a single one is also available as ``y``.
    """
    targets = [target] if isinstance(target, str) else list(target)
    slim = df.select(
        *keys,
        ord_col,
        F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("row"),
        *[F.col(f"`{c}`") for c in targets],
    )
    frame = in_chunk(keys, ord_col).rowsBetween(-look_back, -1)
    x = F.collect_list("row").over(frame)
    spread = with_halo(slim, ord_col, look_back, chunk_rows)
    if scale is None:
        windows = spread.withColumn("x", x)
    elif scale == "window":
        d = len(features)
        ends = {f"lo_{i}": F.min(F.col("row")[i]).over(frame) for i in range(d)}
        ends |= {f"hi_{i}": F.max(F.col("row")[i]).over(frame) for i in range(d)}
        windows = spread.withColumns({"x": x, **ends})

        def unit(r):
            spans = [(r[i] - F.col(f"lo_{i}"), F.col(f"hi_{i}") - F.col(f"lo_{i}")) for i in range(d)]
            return F.array(*[F.when(width == 0, F.lit(0.0)).otherwise(F.try_divide(gap, width)) for gap, width in spans])

        windows = windows.withColumn("x", F.transform("x", unit))
    else:
        raise ValueError(f"scale {scale!r}: expected 'window' or None")
    labels = [F.col(f"`{targets[0]}`").alias("y")] if isinstance(target, str) else [F.col(f"`{c}`") for c in targets]
    return windows.where(F.col("own") & (F.size("x") == look_back)).select(*keys, ord_col, "x", *labels)
