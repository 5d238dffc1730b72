"""Price-move labels on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.nulls import exprs, ratio
from tidebook.operators.bars import neighbour_names, with_neighbours


def three_class(move: str, threshold: float = 0.0) -> str:
    """0 down, 1 flat, 2 up; moves of at most ``threshold`` are flat, and so is a missing move."""
    return f"CAST(1 + CASE WHEN abs({move}) > {float(threshold)!r}D THEN signum({move}) ELSE 0 END AS INT)"


def up_class(move: str, zero_is_up: bool = False) -> str:
    """1 up, 0 otherwise; a missing move is 0."""
    return f"CASE WHEN {move} {'>=' if zero_is_up else '>'} 0 THEN 1 ELSE 0 END"


def moves() -> dict[str, str]:
    """Relative moves within the bar: last mid, mean mid and last weighted mid against the first."""
    against = {
        "mid_price_variation": ratio("mid_price_last", "mid_price_first"),
        "mean_mid_price_variation": ratio("mid_price_mean", "mid_price_first"),
        "weighted_mid_price_variation": ratio("weighted_mid_price_last", "weighted_mid_price_first"),
    }
    return {name: f"{value} - 1" for name, value in against.items()}


def next_bins_mean(name: str, bins: int) -> str:
    """Mean of ``name`` over this and the next ``bins - 1`` grid bins, for bars with as many bins before.

    NULL if a bin in between has no ticks, if a value is missing or if the bar is among the first
    ``bins - 1`` grid bins of the session (a trailing window over the shifted series is short there).
    Needs ``after_1`` to ``after_{bins - 1}``.
    """
    total = " + ".join([name, *[f"after_{k}.{name}" for k in range(1, bins)]])
    no_gap = f"after_{bins - 1}.bar_ix = bar_ix + {bins - 1}"
    return f"CASE WHEN {no_gap} AND bar_ix - first_ix >= {bins - 1} THEN ({total}) / {float(bins)}D END"


def classes_of_moves(threshold: float, zero_is_up: bool) -> dict[str, str]:
    """Class labels over the moves; needs ``after_1`` to ``after_4``."""
    return {
        "mid_price_variation_class": three_class("mid_price_variation", threshold),
        "mean_mid_price_variation_class": up_class("mean_mid_price_variation", zero_is_up),
        "next_5_mean_mid_price_variation_class": up_class(next_bins_mean("mean_mid_price_variation", 5)),
        "weighted_mid_price_variation_class": up_class("weighted_mid_price_variation"),
    }


def labels(bars: DataFrame, threshold: float = 0.0, zero_is_up: bool = True) -> DataFrame:
    """Add moves and class labels. ``zero_is_up`` decides the class of an unchanged mean mid-price."""
    ahead = with_neighbours(bars.withColumns(exprs(moves())), ["mean_mid_price_variation"], ahead=4)
    return ahead.withColumns(exprs(classes_of_moves(threshold, zero_is_up))).drop(*neighbour_names(ahead=4))


def next_bar_target(df: DataFrame, target: str, order: str = "bar_ix") -> DataFrame:
    """Replace ``target`` by its value in the symbol's next bar, also across sessions; drop the last bar.

    Inside a session this is a plain ``lead``. Only the last bar of a session needs the next session, so
    the step across sessions runs on one row per session instead of on a whole symbol in one task.
    """
    in_session = f"(PARTITION BY symbol, session ORDER BY {order})"
    firsts = df.groupBy("symbol", "session").agg(F.min_by(target, order).alias("first_value"))
    opening = F.lead("first_value").over(Window.partitionBy("symbol").orderBy("session"))
    following = firsts.select("symbol", "session", opening.alias("next_session_value"))
    shifted = df.withColumns(
        exprs(
            {
                "next_value": f"lead({target}) OVER {in_session}",
                "is_last": f"lead({order}) OVER {in_session} IS NULL",
            }
        )
    ).join(following, ["symbol", "session"], "left")
    moved = shifted.withColumn(target, F.expr("CASE WHEN is_last THEN next_session_value ELSE next_value END"))
    return moved.drop("next_value", "next_session_value", "is_last").where(f"{target} IS NOT NULL")
