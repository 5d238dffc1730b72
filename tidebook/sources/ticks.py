"""Tick scans, the trading calendar and the feature-table sink.

Every scan returns the same tick frame, one row per book event:

``symbol, session, ts_us, seq, action, side, price, size, bid_px_00, ask_px_00, bid_px_01,
ask_px_01, bid_sz_00, ask_sz_00``

``ts_us`` is the stored wall clock in epoch microseconds. ``seq`` is a total order of the ticks of one
``(symbol, session)`` that agrees with ``ts_us``; first/last aggregates rely on it. Being one BIGINT it
keeps the tick aggregation a hash aggregate; a struct key would force a sort of every tick.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.nulls import nan_to_null
from tidebook.functions.rates import clock_us, session_of, time_of_day_us

PRICE_COLUMNS = ["price", "bid_px_00", "ask_px_00", "bid_px_01", "ask_px_01"]
SIZE_COLUMNS = ["size", "bid_sz_00", "ask_sz_00"]
CODE_COLUMNS = ["action", "side"]
TICK_COLUMNS = ["symbol", "session", "ts_us", "seq", *CODE_COLUMNS, *PRICE_COLUMNS, *SIZE_COLUMNS]

# Stored integer -> microseconds, as (multiplier, divisor).
_TIME_UNITS = {"ns": (1, 1_000), "us": (1, 1), "ms": (1_000, 1)}
DAY = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}")
#: Days whose hours are filtered one by one.
MOST_RANGES = 64


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday-to-Friday dates from ``start`` to ``end``, both included; holidays are not known."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session")
    )
    return days.where(F.weekday("session") < 5)


DAILY_FILES = "{symbol}_{day:%Y-%m-%d}_xnas-itch.parquet"


def daily_paths(folder: str, days: Iterable[date], symbols: Sequence[str], pattern: str = DAILY_FILES) -> list[str]:
    """One path per symbol and day."""
    return [f"{folder.rstrip('/')}/{pattern.format(symbol=s, day=d)}" for s in symbols for d in days]


DAILY_FOLDERS = "file={symbol}_{day:%Y-%m-%d}_xnas-itch.parquet"


def write_daily_ticks(ticks: DataFrame, folder: str, order: Sequence[str]) -> None:
    """One folder with one file per symbol and day, rows in the given order; read with ``DAILY_FOLDERS`` as pattern."""
    named = ticks.withColumn("file", F.expr("concat(symbol, '_', date_format(session, 'yyyy-MM-dd'), '_xnas-itch.parquet')"))
    gathered = named.drop("symbol", "session").repartition("file").sortWithinPartitions("file", *order)
    gathered.write.partitionBy("file").parquet(folder)


def missing_sessions(ticks: DataFrame, start: str, end: str) -> DataFrame:
    """``(symbol, session)`` pairs without a tick: every symbol seen, every business day of the range."""
    have = ticks.select("symbol", "session").distinct()
    span = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    wanted = have.select("symbol").distinct().withColumn("session", F.explode(span)).where(F.weekday("session") < 5)
    return wanted.join(have, ["symbol", "session"], "left_anti")


def _wall_clock_us(col: str, unit: str, zone: str | None) -> str:
    if unit not in _TIME_UNITS:
        raise ValueError(f"time unit {unit!r}: expected one of {sorted(_TIME_UNITS)}")
    mult, div = _TIME_UNITS[unit]
    us = f"{col} * {mult}L" if mult > 1 else f"{col} DIV {div}L"
    return us if zone is None else f"unix_micros(from_utc_timestamp(timestamp_micros({us}), '{zone}'))"


def read_daily_ticks(
    spark: SparkSession,
    paths: Sequence[str],
    time_col: str = "ts_event",
    time_unit: str = "ns",
    zone: str | None = None,
    hours: tuple[str, str] | None = None,
) -> DataFrame:
    """Scan ``{symbol}_{date}_…parquet`` files, or folders of one file; symbol and session come from that name.

    ``time_col`` picks the event clock. The time column is read as its stored integer (pandas writes
    nanoseconds, which Spark has no timestamp type for), in ``time_unit``; ``zone`` shifts a UTC clock to a
    local one, the default keeps the stored wall clock. ``seq`` is the row index in the file: the order of a file
    that is sorted by time, else the tie-break of ``tick_order``. ``hours`` keeps the ticks of those hours; on the
    stored wall clock they are also plain ranges, one a day, that reach the row groups' statistics. A missing file
    is an error.
    """
    schema = T.StructType(
        [T.StructField(time_col, T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CODE_COLUMNS]
        + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
        + [T.StructField(c, T.LongType()) for c in SIZE_COLUMNS]
    )
    raw = spark.read.schema(schema).parquet(*paths)
    if hours and zone is None:
        raw = raw.where(stored_hours(f"`{time_col}`", time_unit, {day for path in paths for day in re.findall(DAY, path)}, *hours))
    named, row = f"'([^/=]+)_({DAY.pattern})_[^/]*[.]parquet'", "_metadata.row_index"
    ts_us = _wall_clock_us(f"`{time_col}`", time_unit, zone)
    ticks = raw.selectExpr(
        f"regexp_extract(_metadata.file_path, {named}, 1) AS symbol",
        f"to_date(regexp_extract(_metadata.file_path, {named}, 2)) AS session",
        f"{ts_us} AS ts_us",
        f"CAST({row} AS BIGINT) AS seq",
        *CODE_COLUMNS,
        *PRICE_COLUMNS,
        *SIZE_COLUMNS,
    )
    return nan_to_null(market_hours(ticks, *hours) if hours else ticks)


def tick_order(time_ordered: bool = True) -> tuple[str, ...]:
    """What orders the ticks of a daily file: its rows, or time and then rows if it is not sorted by time."""
    return ("seq",) if time_ordered else ("ts_us", "seq")


def stored_hours(column: str, unit: str, days: Iterable[str], opens: str, closes: str) -> str:
    """A range of the stored clock for each day, or one over all days where they are many."""
    mult, div = _TIME_UNITS[unit]
    first, last = (clock_us(c) * div // mult for c in (opens, closes))
    midnights = sorted((date.fromisoformat(d) - date(1970, 1, 1)).days * 86_400_000_000 * div // mult for d in days)
    spans = [(m + first, m + last + div - 1) for m in midnights]
    if len(spans) > MOST_RANGES:
        spans = [(spans[0][0], spans[-1][1])]
    return " OR ".join(f"({column} >= {low}L AND {column} <= {high}L)" for low, high in spans) or "true"


def read_tick_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Scan a tick table partitioned by ``session`` (and ``symbol``); the date range prunes directories."""
    ticks = spark.read.parquet(path)
    if start:
        ticks = ticks.where(F.col("session") >= F.to_date(F.lit(start)))
    if end:
        ticks = ticks.where(F.col("session") <= F.to_date(F.lit(end)))
    return nan_to_null(ticks.withColumn("symbol", F.col("symbol").cast("string")).select(*TICK_COLUMNS))


def market_hours(ticks: DataFrame, opens: str = "09:30", closes: str = "16:00") -> DataFrame:
    """Ticks whose time of day lies in ``[opens, closes]``, both ends included."""
    return ticks.where(f"{time_of_day_us()} BETWEEN {clock_us(opens)} AND {clock_us(closes)}")


def ticks_of_events(events: DataFrame, symbols: int = 1) -> DataFrame:
    """The tick frame derived from an ``events`` table; ``event_id`` is the order.

    ``events.ts`` must be read as TIMESTAMP so that its stored microseconds come through unchanged.
    """
    base, step = "100D + floor(value) / 64D", "1 / 64D"
    bid = f"CASE WHEN event_id % 97 <> 0 THEN {base} END"
    ask = f"CASE WHEN event_id % 89 <> 0 THEN {base} + (1 + event_id % 5) / 64D END"
    action = "CASE event_type WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'C' WHEN 'signup' THEN 'M' ELSE 'A' END"
    return events.selectExpr(
        f"CAST(pmod(user_id, {symbols}) AS STRING) AS symbol",
        f"{session_of('unix_micros(ts)')} AS session",
        "unix_micros(ts) AS ts_us",
        "event_id AS seq",
        f"{action} AS action",
        "CASE WHEN (event_id DIV 3) % 2 = 0 THEN 'B' ELSE 'A' END AS side",
        f"{base} AS price",
        f"{bid} AS bid_px_00",
        f"{ask} AS ask_px_00",
        f"{bid} - {step} AS bid_px_01",
        f"{ask} + {step} AS ask_px_01",
        "1 + event_id % 100 AS size",
        "event_id * 7 % 50 AS bid_sz_00",
        "event_id * 13 % 40 AS ask_sz_00",
    )


EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE"


def event_ticks(spark: SparkSession, folder: str, symbols: int = 1) -> DataFrame:
    """Tick frame over ``{folder}/events.parquet``."""
    return ticks_of_events(spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parquet"), symbols)


def write_features(df: DataFrame, path: str, buckets: int | None = None, table: str | None = None) -> None:
    """Save a feature or tick table, one directory per session.

    Rows are gathered by ``(session, symbol)``, and a symbol and day with very many rows is spread over several
    tasks and files of even size. Within a file rows are in order of time where the table has one, so that
    row-group statistics serve a filter on it. With ``table`` and ``buckets`` the files are also bucketed by
    ``(symbol, session)``, so later windows and joins on that key need no shuffle; a bucket is one task.
    """
    clock = [c for c in ("bar_ts", "ts_us") if c in df.columns]
    if table:
        if not buckets:
            raise ValueError("a bucketed table needs a bucket count")
        gathered = df.repartition(buckets, "symbol", "session")
        writer = gathered.write.bucketBy(buckets, "symbol", "session").sortBy(*clock).option("path", path)
        writer.format("parquet").saveAsTable(table)
        return
    even = df.hint("rebalance", "session", "symbol").sortWithinPartitions("session", "symbol", *clock)
    even.write.partitionBy("session").parquet(path)
