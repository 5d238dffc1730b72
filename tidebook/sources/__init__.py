"""Where ticks come from and where feature tables go."""

from tidebook.sources.ticks import (
    TICK_COLUMNS,
    business_days,
    daily_paths,
    market_hours,
    missing_sessions,
    read_daily_ticks,
    read_tick_table,
    write_features,
)

__all__ = [
    "TICK_COLUMNS",
    "business_days",
    "daily_paths",
    "market_hours",
    "missing_sessions",
    "read_daily_ticks",
    "read_tick_table",
    "write_features",
]
