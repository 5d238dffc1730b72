"""Calendar features of a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidebook.functions.nulls import exprs
from tidebook.functions.rates import clock_us, rate_us

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]


def calendar_features(bars: DataFrame, rate: str, opens: str = "09:30") -> DataFrame:
    """Seconds since the open (negative before it) and one flag per weekday."""
    flags = {f"is_{name}": f"CAST(weekday(session) = {k} AS INT)" for k, name in enumerate(WEEKDAYS)}
    after_open = f"(bar_ix * {rate_us(rate)}L - {clock_us(opens)}L) / 1e6D"
    return bars.withColumns(exprs({"time_since_open": after_open, **flags}))


def market_session(bars: DataFrame, hours: float = 3.5) -> DataFrame:
    """1 for bars later than ``hours`` after the open, else 0; needs ``time_since_open``."""
    return bars.withColumns(exprs({"market_session": f"CAST(time_since_open > {hours * 3600!r}D AS INT)"}))
