"""NULL is the only missing value: NaN never leaves the scan and division never raises.

The helpers build SQL expression text, which Spark parses in one call per column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.expr(f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))") for c in floats})


def ratio(num: str, den: str) -> str:
    """``num / den`` as DOUBLE, NULL when ``den`` is zero or either side is missing."""
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def all_present(columns: Iterable[str]) -> str:
    """True when none of the columns is NULL."""
    return " AND ".join(f"`{c}` IS NOT NULL" for c in columns)


def truncated(value: str) -> str:
    """Whole part, toward zero."""
    return f"CAST({value} AS BIGINT)"


def exprs(columns: dict[str, str]) -> dict[str, Column]:
    """Parsed columns for ``withColumns``."""
    return {name: F.expr(text) for name, text in columns.items()}
