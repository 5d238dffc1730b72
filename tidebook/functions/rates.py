"""Bar rates and time-of-day arithmetic on integer microseconds."""

from __future__ import annotations

import re

DAY_US = 86_400_000_000

_UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
}


def rate_us(rate: str) -> int:
    """Microseconds in a rate such as ``"200ms"``, ``"1s"``, ``"5min"`` or ``"1h"``."""
    match = re.fullmatch(r"\s*(\d+)?\s*(us|ms|s|min|h)\s*", rate)
    if not match:
        raise ValueError(f"rate {rate!r}: expected a count and one of {sorted(_UNIT_US)}")
    width = int(match.group(1) or 1) * _UNIT_US[match.group(2)]
    if not 0 < width <= DAY_US:
        raise ValueError(f"rate {rate!r}: must be positive and at most one day")
    return width


def clock_us(clock: str) -> int:
    """Microseconds after midnight of ``"HH:MM"`` or ``"HH:MM:SS"``."""
    hours, minutes, *rest = clock.split(":")
    seconds = float(rest[0]) if rest else 0.0
    return (int(hours) * 3600 + int(minutes) * 60) * 1_000_000 + round(seconds * 1_000_000)


def time_of_day_us(ts_us: str = "ts_us") -> str:
    """Microseconds after midnight of an epoch-microsecond column."""
    return f"pmod({ts_us}, {DAY_US}L)"


def bar_index(rate: str, ts_us: str = "ts_us") -> str:
    """Index of the left-closed bin of the day; bin 0 starts at midnight for every rate."""
    return f"{time_of_day_us(ts_us)} DIV {rate_us(rate)}L"


def bar_start(rate: str) -> str:
    """Start of the bin as TIMESTAMP_NTZ, from ``session`` and ``bar_ix`` (no time zone involved)."""
    seconds = rate_us(rate) / 1_000_000
    return f"CAST(session AS TIMESTAMP_NTZ) + bar_ix * INTERVAL '{seconds:.6f}' SECOND"


def session_of(ts_us: str = "ts_us") -> str:
    """Calendar date of an epoch-microsecond column."""
    return f"date_from_unix_date(CAST(floor({ts_us} / {DAY_US}L) AS INT))"


def bars_a_day(rate: str) -> int:
    """The most bars a session can have."""
    return -(-DAY_US // rate_us(rate))


def bars_of_hours(rate: str, opens: str, closes: str) -> int:
    """The most bars a session can have whose ticks lie in ``[opens, closes]``, both ends included."""
    return max(0, clock_us(closes) // rate_us(rate) - clock_us(opens) // rate_us(rate) + 1)
