"""Order-book features on bars: imbalance, flow and changes from the bar before."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidebook.functions.nulls import all_present, exprs, ratio, truncated
from tidebook.operators.bars import DEVIATION, QUOTE_STATS, TRADE_STATS, grid_mean, neighbour_names, with_neighbours
from tidebook.operators.labels import classes_of_moves, moves

MOVES = ["mid_price_variation", "mean_mid_price_variation", "weighted_mid_price_variation"]
LABELS = [
    "mid_price_variation_class",
    "mean_mid_price_variation_class",
    "next_5_mean_mid_price_variation_class",
    "weighted_mid_price_variation_class",
]
BOOK = [
    "total_bid_volume",
    "total_ask_volume",
    "mean_order_book_imbalance",
    "last_order_book_imbalance",
    "total_net_order_flow",
    "num_added_orders",
    "num_canceled_orders",
    "num_traded_orders",
    "order_book_imbalance_5s",
    "order_flow_5s",
    "bid_volume_variation",
    "ask_volume_variation",
    "bid_price_variation",
    "ask_price_variation",
]
# Columns whose presence implies that of all the others. A deviation needs two values, so with it the
# first, last, mean, high and low exist; one trade price brings the other three; labels are never NULL.
# Fewer checks keep the generated filter small enough for the JIT compiler.
DECISIVE = [*DEVIATION, "mean_second_ask_price", "mean_second_bid_price", *MOVES, *BOOK, "trade_open"]
BAR_COLUMNS = [*QUOTE_STATS, *MOVES, *LABELS, *BOOK, *TRADE_STATS]


def imbalance(bid_size: str, ask_size: str) -> str:
    """Difference of the whole sizes over the sum of the sizes."""
    return ratio(f"{truncated(bid_size)} - {truncated(ask_size)}", f"{bid_size} + {ask_size}")


def change(name: str) -> str:
    """Difference of whole parts from the bar before; needs ``before_1``.

    Carried columns repeat through empty bins, so the occupied bar before and the grid bin before agree.
    """
    return f"{truncated(name)} - {truncated(f'before_1.{name}')}"


# Columns the book features look back at.
LOOKED_BACK = [
    "mean_order_book_imbalance",
    "total_net_order_flow",
    "last_best_bid_size",
    "last_best_ask_size",
    "last_best_bid_price",
    "last_best_ask_price",
]


def levels() -> dict[str, str]:
    """Imbalances and net order flow of the bar itself."""
    return {
        "mean_order_book_imbalance": imbalance("mean_best_bid_size", "mean_best_ask_size"),
        "last_order_book_imbalance": imbalance("last_best_bid_size", "last_best_ask_size"),
        "total_net_order_flow": f"{truncated('last_best_bid_size')} - {truncated('last_best_ask_size')}",
    }


def changes() -> dict[str, str]:
    """Five-bin means and bar-to-bar changes; needs ``before_1`` to ``before_4``.

    The means keep the ``_5s`` names although they span five bins of any rate.
    """
    return {
        "order_book_imbalance_5s": grid_mean("mean_order_book_imbalance", 5),
        "order_flow_5s": grid_mean("total_net_order_flow", 5),
        "bid_volume_variation": change("last_best_bid_size"),
        "ask_volume_variation": change("last_best_ask_size"),
        "bid_price_variation": change("last_best_bid_price"),
        "ask_price_variation": change("last_best_ask_price"),
    }


def book_features(bars: DataFrame) -> DataFrame:
    """Imbalances, net order flow, five-bin means and bar-to-bar changes."""
    back = with_neighbours(bars.withColumns(exprs(levels())), LOOKED_BACK, back=4)
    return back.withColumns(exprs(changes())).drop(*neighbour_names(back=4))


def labelled_book(bars: DataFrame, threshold: float = 0.0, zero_is_up: bool = True) -> DataFrame:
    """``labels`` and ``book_features`` together, with one window operator for both."""
    both = bars.withColumns(exprs(moves() | levels()))
    near = with_neighbours(both, [*LOOKED_BACK, "mean_mid_price_variation"], back=4, ahead=4)
    derived = classes_of_moves(threshold, zero_is_up) | changes()
    return near.withColumns(exprs(derived)).drop(*neighbour_names(back=4, ahead=4))


def complete_bars(features: DataFrame) -> DataFrame:
    """Bars without a missing value; a bar without a trade is never complete."""
    return features.where(all_present(DECISIVE))
