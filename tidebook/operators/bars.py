"""Ticks to fixed-rate bars.

``aggregate_bars`` is the only operator that touches ticks at full volume. It is one hash aggregate
with map-side partial sums, so what is shuffled is bars, not ticks, and a hot symbol costs no more than
its number of bars. Everything after it works per ``(symbol, session)``, whose bar count is bounded by
the session length over the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebook.functions.nulls import exprs, ratio
from tidebook.functions.rates import bar_index, bar_start

KEYS = ["symbol", "session", "bar_ix"]

TRADE, ADD, CANCEL = "action = 'T'", "action = 'A'", "action = 'C'"
BID, ASK = "side = 'B'", "side = 'A'"

# Output name -> tick column it summarises, by statistic.
FIRST = {"mid_price_first": "mid_price", "weighted_mid_price_first": "weighted_mid_price"}
LAST = {
    "mid_price_last": "mid_price",
    "weighted_mid_price_last": "weighted_mid_price",
    "last_spread": "bid_ask_spread",
    "last_best_bid_price": "bid_px_00",
    "last_best_ask_price": "ask_px_00",
    "last_best_bid_size": "bid_sz_00",
    "last_best_ask_size": "ask_sz_00",
}
MEAN = {
    "mid_price_mean": "mid_price",
    "weighted_mid_price_mean": "weighted_mid_price",
    "mean_spread": "bid_ask_spread",
    "mean_best_bid_price": "bid_px_00",
    "mean_best_ask_price": "ask_px_00",
    "mean_best_bid_size": "bid_sz_00",
    "mean_best_ask_size": "ask_sz_00",
    "mean_second_ask_price": "ask_px_01",
    "mean_second_bid_price": "bid_px_01",
}
DEVIATION = {
    "std_mid_price": "mid_price",
    "std_spread": "bid_ask_spread",
    "std_best_bid_size": "bid_sz_00",
    "std_best_ask_size": "ask_sz_00",
}
QUOTE_STATS = [*FIRST, *LAST, *MEAN, *DEVIATION, "mid_price_high", "mid_price_low"]
TRADE_STATS = ["trade_open", "trade_close", "trade_high", "trade_low"]
# Volume flows (size sums) and action counts; NULL where the bar has no such tick.
FLOWS = {
    "added_bid": f"{ADD} AND {BID}",
    "canceled_bid": f"{CANCEL} AND {BID}",
    "added_ask": f"{ADD} AND {ASK}",
    "canceled_ask": f"{CANCEL} AND {ASK}",
}
COUNTS = {"num_added_orders": ADD, "num_canceled_orders": CANCEL, "num_traded_orders": TRADE}

# Bar columns that keep their last known value through bins without ticks.
CARRIED = [
    "last_best_bid_size",
    "last_best_ask_size",
    "last_best_bid_price",
    "last_best_ask_price",
    "mean_best_bid_size",
    "mean_best_ask_size",
]


SESSION = "PARTITION BY symbol, session ORDER BY bar_ix"
SO_FAR = f"({SESSION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
# The sort is not needed for this frame, but with it the frame runs in the same window operator.
WHOLE = f"({SESSION} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def by_session() -> WindowSpec:
    return Window.partitionBy("symbol", "session").orderBy("bar_ix")


def tick_prices(ticks: DataFrame) -> DataFrame:
    """Add mid-price, spread and size-weighted mid-price to every tick."""
    weighted = ratio("ask_px_00 * bid_sz_00 + bid_px_00 * ask_sz_00", "bid_sz_00 + ask_sz_00")
    return ticks.withColumns(
        exprs(
            {
                "mid_price": "coalesce((ask_px_00 + bid_px_00) / 2, ask_px_00, bid_px_00)",
                "bid_ask_spread": "ask_px_00 - bid_px_00",
                "weighted_mid_price": f"coalesce({weighted}, ask_px_00, bid_px_00)",
            }
        )
    )


def action_masks(ticks: DataFrame) -> DataFrame:
    """Add the trade/add/cancel and bid/ask flags as boolean columns."""
    masks = {"is_trade": TRADE, "is_add": ADD, "is_cancel": CANCEL, "is_bid": BID, "is_ask": ASK}
    return ticks.withColumns(exprs({name: f"coalesce({mask}, false)" for name, mask in masks.items()}))


def aggregate_bars(ticks: DataFrame, rate: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per occupied bin: quote statistics, trade OHLC, size flows and action counts.

    ``order`` names the columns that order the ticks of a session. One integer column keeps the
    aggregation hash-based; ``("ts_us", "seq")`` is always safe but sorts the ticks.
    """
    key = order[0] if len(order) == 1 else f"struct({', '.join(order)})"

    def extreme(function: str, value: str) -> str:
        return f"{function}({value}, CASE WHEN {value} IS NOT NULL THEN {key} END)"

    trade_price = f"CASE WHEN {TRADE} THEN price END"
    columns = {name: extreme("min_by", c) for name, c in FIRST.items()}
    columns |= {name: extreme("max_by", c) for name, c in LAST.items()}
    columns |= {name: f"avg({c})" for name, c in MEAN.items()}
    columns |= {name: f"stddev_samp({c})" for name, c in DEVIATION.items()}
    columns |= {"mid_price_high": "max(mid_price)", "mid_price_low": "min(mid_price)"}
    columns |= {"trade_open": extreme("min_by", "trade_price"), "trade_close": extreme("max_by", "trade_price")}
    columns |= {"trade_high": "max(trade_price)", "trade_low": "min(trade_price)"}
    columns |= {name: f"sum(CASE WHEN {mask} THEN coalesce(size, 0) END)" for name, mask in FLOWS.items()}
    columns |= {name: f"sum(CASE WHEN {mask} THEN 1 END)" for name, mask in COUNTS.items()}
    keyed = tick_prices(ticks).withColumns(exprs({"trade_price": trade_price, "bar_ix": bar_index(rate)}))
    return keyed.groupBy(*KEYS).agg(*[F.expr(f"{text} AS {name}") for name, text in columns.items()])


def _with_spans(bars: DataFrame) -> DataFrame:
    """Carry quotes forward and add the first and last bin of every masked subset of the session."""
    out = {c: f"last({c}) IGNORE NULLS OVER {SO_FAR}" for c in CARRIED}
    for name in [*FLOWS, *COUNTS]:
        occupied = f"CASE WHEN {name} IS NOT NULL THEN bar_ix END"
        out |= {f"{name}_lo": f"min({occupied}) OVER {WHOLE}", f"{name}_hi": f"max({occupied}) OVER {WHOLE}"}
    out["first_ix"] = f"min(bar_ix) OVER {WHOLE}"
    return bars.withColumns(exprs(out))


def _within_spans(spanned: DataFrame) -> DataFrame:
    """Net the flows and zero-fill the counts inside their spans; outside of them they are missing.

    A net volume needs both of its subsets to cover the bin.
    """

    def covered(name: str) -> str:
        return f"bar_ix BETWEEN {name}_lo AND {name}_hi"

    def net(added: str, canceled: str) -> str:
        inside = f"{covered(added)} AND {covered(canceled)}"
        return f"CASE WHEN {inside} THEN coalesce({added}, 0) - coalesce({canceled}, 0) END"

    out = {c: f"CASE WHEN {covered(c)} THEN coalesce({c}, 0) END" for c in COUNTS}
    out["total_bid_volume"] = net("added_bid", "canceled_bid")
    out["total_ask_volume"] = net("added_ask", "canceled_ask")
    spans = [f"{name}_{end}" for name in [*FLOWS, *COUNTS] for end in ("lo", "hi")]
    return spanned.withColumns(exprs(out)).drop(*FLOWS, *spans)


def bars(ticks: DataFrame, rate: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Occupied bars of every session with carried quotes, net volumes and counts."""
    return _within_spans(_with_spans(aggregate_bars(ticks, rate, order)))


def dense_grid(ticks: DataFrame, rate: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """All bins from the first to the last occupied one, quotes carried into empty bins.

    Each occupied bar also emits the empty bins up to the next one: no second pass, no join. The
    feature pipeline gets the same lags without these rows (``grid_value``), because for thinly traded
    symbols the grid is many times larger than the ticks.
    """
    spanned = _with_spans(aggregate_bars(ticks, rate, order))
    upto = F.expr(f"coalesce(lead(bar_ix) OVER ({SESSION}) - 1, bar_ix)")
    bins = spanned.withColumn("upto", upto).withColumn("grid_ix", F.expr("explode(sequence(bar_ix, upto))"))
    per_bin = [c for c in [*QUOTE_STATS, *TRADE_STATS, *FLOWS, *COUNTS] if c not in CARRIED]
    grid = bins.withColumns(exprs({c: f"CASE WHEN grid_ix = bar_ix THEN {c} END" for c in per_bin}))
    return _within_spans(grid.drop("bar_ix", "upto").withColumnRenamed("grid_ix", "bar_ix"))


def with_neighbours(bars: DataFrame, columns: Sequence[str], back: int = 0, ahead: int = 0) -> DataFrame:
    """Add ``before_k`` and ``after_k``: structs of ``bar_ix`` and ``columns`` of the k-th bar before and after.

    One offset per distance serves every column, where a lag per column and distance would each walk
    the session again.
    """
    picked = f"struct({', '.join(['bar_ix', *columns])})"
    out = {f"before_{k}": f"lag({picked}, {k}) OVER ({SESSION})" for k in range(1, back + 1)}
    out |= {f"after_{k}": f"lead({picked}, {k}) OVER ({SESSION})" for k in range(1, ahead + 1)}
    return bars.withColumns(exprs(out))


def neighbour_names(back: int = 0, ahead: int = 0) -> list[str]:
    return [f"before_{k}" for k in range(1, back + 1)] + [f"after_{k}" for k in range(1, ahead + 1)]


def grid_value(name: str, back: int) -> str:
    """Value that ``name`` has on the gap-free grid ``back`` bins before the current bar.

    On that grid a bin without ticks repeats the bar before it, so the value is the one of the latest
    occupied bar at or before the bin. ``back`` bars of history are enough because a bin holds at most
    one bar. NULL before the session's first bar. Needs ``before_1`` to ``before_{back}``.
    """
    if back == 0:
        return name
    found = " ".join(f"WHEN before_{k}.bar_ix <= bar_ix - {back} THEN before_{k}.{name}" for k in range(1, back + 1))
    return f"CASE {found} END"


def grid_mean(name: str, bins: int) -> str:
    """Mean over the current and the previous ``bins - 1`` grid bins; NULL unless all of them exist."""
    total = " + ".join(grid_value(name, back) for back in range(bins - 1, -1, -1))
    return f"({total}) / {float(bins)}D"


def with_bar_time(df: DataFrame, rate: str) -> DataFrame:
    """Add ``bar_ts``, the bin start."""
    return df.withColumn("bar_ts", F.expr(bar_start(rate)))
