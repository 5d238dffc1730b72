"""Ticks to the full feature table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidebook.functions.nulls import all_present
from tidebook.functions.rates import bars_a_day, bars_of_hours
from tidebook.operators.bars import bars, with_bar_time
from tidebook.operators.book import BAR_COLUMNS, complete_bars, labelled_book
from tidebook.operators.calendar import WEEKDAYS, calendar_features
from tidebook.operators.indicators import NATIVE, native_indicators
from tidebook.operators.recursive import RECURSIVE, recursive_indicators
from tidebook.sources.ticks import DAILY_FILES, daily_paths, read_daily_ticks, tick_order

INDICATORS = [
    *[c for c in RECURSIVE if c.startswith(("ADX", "DM"))],
    *[c for c in NATIVE if not c.startswith(("CO", "C1", "C2", "C3", "range", "OH1"))],
    *[c for c in RECURSIVE if not c.startswith(("ADX", "DM"))],
    "CO",
    "C1O1",
    "C2O2",
    "C3O3",
    "range",
    "OH1",
]
# The longest warm-up, and the only indicators that can be missing after it.
LAST_READY = ["MACD_8_21_5", "STOCHk_7_3_3", "STOCHd_7_3_3"]
CALENDAR = ["time_since_open", *[f"is_{d}" for d in WEEKDAYS]]


def bar_features(
    ticks: DataFrame, rate: str, threshold: float = 0.0, zero_is_up: bool = True, order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Complete bars with labels and book features."""
    return complete_bars(labelled_book(bars(ticks, rate, order), threshold, zero_is_up))


def indicators(bar_table: DataFrame, ties: str = "latest", session_bars: int | None = None) -> DataFrame:
    """Add all indicators to complete bars and drop the warm-up rows; ``ties`` is Aroon's, ``session_bars`` the most
    bars of a session.

    Window indicators run first: they share the session partitioning and sort of the bar windows, and
    the Arrow pass that follows reuses both.
    """
    full_set = recursive_indicators(native_indicators(bar_table, ties), session_bars)
    return full_set.where(all_present(LAST_READY))


def features_of(
    ticks: DataFrame,
    rate: str,
    threshold: float = 0.0,
    zero_is_up: bool = True,
    order: Sequence[str] = ("seq",),
    ties: str = "latest",
    session_bars: int | None = None,
) -> DataFrame:
    """Bars, labels, book features, indicators and calendar of a tick frame; ``session_bars`` is the most bars of a
    session, all bins of a day by default."""
    most = bars_a_day(rate) if session_bars is None else session_bars
    table = calendar_features(indicators(bar_features(ticks, rate, threshold, zero_is_up, order), ties, most), rate)
    names = [*BAR_COLUMNS, *INDICATORS, *CALENDAR]
    return with_bar_time(table, rate).selectExpr("symbol", "session", "bar_ts", "bar_ix", *[f"`{c}`" for c in names])


def weekdays_between(start: str, end: str) -> list[date]:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = (first + timedelta(days=k) for k in range((last - first).days + 1))
    return [d for d in days if d.weekday() < 5]


def feature_table(
    spark: SparkSession,
    folder: str,
    start: str,
    end: str,
    rate: str = "1s",
    threshold: float = 0.0,
    symbols: Sequence[str] = ("AAPL",),
    time_col: str = "ts_event",
    time_unit: str = "ns",
    zone: str | None = None,
    zero_is_up: bool = True,
    time_ordered: bool = True,
    hours: tuple[str, str] = ("09:30", "16:00"),
    ties: str = "latest",
    pattern: str = DAILY_FILES,
) -> DataFrame:
    """Feature table of the business days from ``start`` to ``end``, read from daily files.

    ``time_ordered=False`` is for files that are not sorted by the chosen clock: ticks are then ordered by time and
    row inside the aggregation, which sorts them in their task; they are not exchanged.
    """
    paths = daily_paths(folder, weekdays_between(start, end), symbols, pattern)
    ticks = read_daily_ticks(spark, paths, time_col, time_unit, zone, hours)
    return features_of(ticks, rate, threshold, zero_is_up, tick_order(time_ordered), ties, bars_of_hours(rate, *hours))
