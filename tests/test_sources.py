from datetime import date

import numpy as np
import pandas as pd
import pytest
from frames import SCHEMA, random_ticks, tick
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidebook.operators.bars import aggregate_bars
from tidebook.plans.feature_table import feature_table, weekdays_between
from tidebook.sources import ticks as src


def day_file(folder, day, times, symbol="AAPL"):
    n = len(times)
    index = pd.DatetimeIndex(pd.to_datetime([f"{day} {t}" for t in times], format="ISO8601"), name="ts_recv")
    frame = pd.DataFrame(
        {
            "ts_event": index.values - np.timedelta64(5, "ns"),
            "action": ["T"] * n,
            "side": ["B"] * n,
            "price": np.arange(n, dtype=float),
            "size": np.arange(n, dtype="uint32"),
            "bid_px_00": [np.nan] + [100.0] * (n - 1),
            "ask_px_00": [101.0] * n,
            "bid_px_01": [99.0] * n,
            "ask_px_01": [102.0] * n,
            "bid_sz_00": np.ones(n, dtype="uint32"),
            "ask_sz_00": np.ones(n, dtype="uint32"),
            "unused": ["x"] * n,
        },
        index=index,
    )
    frame.to_parquet(f"{folder}/{symbol}_{day}_xnas-itch.parquet")


TIMES = ["09:29:59.999999999", "09:30:00", "09:30:00", "16:00:00.000000", "16:00:00.000001"]


def test_daily_files(spark, tmp_path):
    day_file(tmp_path, "2024-10-07", TIMES)
    day_file(tmp_path, "2024-10-08", TIMES[:2], symbol="MSFT")
    paths = src.daily_paths(str(tmp_path), [date(2024, 10, 7)], ["AAPL"]) + src.daily_paths(
        str(tmp_path), [date(2024, 10, 8)], ["MSFT"]
    )
    got = src.read_daily_ticks(spark, paths, time_col="ts_recv").orderBy("symbol", "seq").collect()
    assert [(r["symbol"], r["session"]) for r in got] == [("AAPL", date(2024, 10, 7))] * 5 + [("MSFT", date(2024, 10, 8))] * 2
    assert [r["seq"] for r in got] == [0, 1, 2, 3, 4, 0, 1]
    assert got[0]["bid_px_00"] is None and got[1]["bid_px_00"] == 100.0
    assert got[0]["ts_us"] % 86_400_000_000 == 34_199_999_999
    event_clock = src.read_daily_ticks(spark, paths[:1], time_col="ts_event").orderBy("seq").collect()
    assert event_clock[1]["ts_us"] == got[1]["ts_us"] - 1
    local = src.read_daily_ticks(spark, paths[:1], time_col="ts_recv", zone="America/New_York").orderBy("seq").collect()
    assert local[1]["ts_us"] == got[1]["ts_us"] - 4 * 3_600_000_000


def test_market_hours_include_both_ends(spark, tmp_path):
    day_file(tmp_path, "2024-10-07", TIMES)
    ticks = src.read_daily_ticks(spark, src.daily_paths(str(tmp_path), [date(2024, 10, 7)], ["AAPL"]), time_col="ts_recv")
    assert sorted(r["seq"] for r in src.market_hours(ticks).collect()) == [1, 2, 3]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        feature_table(spark, str(tmp_path), "2024-10-07", "2024-10-07")


def test_unordered_files_use_time_then_row(spark, tmp_path):
    day_file(tmp_path, "2024-10-07", ["09:30:02", "09:30:01", "09:30:01"])
    paths = src.daily_paths(str(tmp_path), [date(2024, 10, 7)], ["AAPL"])
    ticks = src.read_daily_ticks(spark, paths, time_col="ts_recv")
    bar = aggregate_bars(ticks.withColumn("bid_px_00", F.col("price")).withColumn("ask_px_00", F.col("price")), "1min", src.tick_order(False)).first()
    assert (bar["mid_price_first"], bar["mid_price_last"]) == (1.0, 0.0)
    # Times of different days order within their day; nothing but bars is exchanged.
    plan = aggregate_bars(ticks, "1min", src.tick_order(False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_") > plan.index("Exchange")


def test_hours_reach_the_scan(spark, tmp_path):
    day_file(tmp_path, "2024-10-07", TIMES)
    day_file(tmp_path, "2024-10-08", TIMES)
    paths = src.daily_paths(str(tmp_path), [date(2024, 10, 7), date(2024, 10, 8)], ["AAPL"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for clock in ("ts_recv", "ts_event"):
        kept = src.read_daily_ticks(spark, paths, clock, hours=("09:30", "16:00"))
        assert kept.orderBy("session", "seq").collect() == src.market_hours(src.read_daily_ticks(spark, paths, clock)).orderBy("session", "seq").collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({clock}," in plan and f"LessThanOrEqual({clock}," in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    many = src.stored_hours("t", "ns", [f"2024-{m:02d}-{d:02d}" for m in range(1, 4) for d in range(1, 29)], "09:30", "16:00")
    assert many.count(" AND ") == 1


def test_daily_folders(spark, tmp_path):
    ticks = spark.createDataFrame(random_ticks(3), SCHEMA).withColumn("clock", F.expr("ts_us * 1000"))
    src.write_daily_ticks(ticks, str(tmp_path / "d"), ["seq"])
    days = [r["session"] for r in ticks.select("session").distinct().collect()]
    symbols = [r["symbol"] for r in ticks.select("symbol").distinct().collect()]
    have = {(r["symbol"], r["session"]) for r in ticks.select("symbol", "session").distinct().collect()}
    paths = [p for s in symbols for d in days if (s, d) in have for p in src.daily_paths(str(tmp_path / "d"), [d], [s], src.DAILY_FOLDERS)]
    back = src.read_daily_ticks(spark, paths, "clock")
    shown = ["symbol", "session", "ts_us", "action", "price", "size"]
    assert sorted(map(str, back.select(shown).collect())) == sorted(map(str, ticks.select(shown).collect()))


def test_business_days(spark):
    got = [r["session"] for r in src.business_days(spark, "2024-10-03", "2024-10-08").orderBy("session").collect()]
    assert got == weekdays_between("2024-10-03", "2024-10-08") == [date(2024, 10, d) for d in (3, 4, 7, 8)]


def test_missing_sessions(spark):
    rows = [tick(0, 1, day=date(2024, 10, 7)), tick(0, 1, day=date(2024, 10, 8), symbol="Y")]
    gaps = src.missing_sessions(spark.createDataFrame(rows, SCHEMA), "2024-10-05", "2024-10-08").collect()
    assert sorted((r["symbol"], r["session"].day) for r in gaps) == [("X", 8), ("Y", 7)]


def test_tick_table_round_trip_prunes_sessions(spark, tmp_path):
    ticks = spark.createDataFrame(random_ticks(3), SCHEMA)
    src.write_features(ticks, str(tmp_path / "t"))
    back = src.read_tick_table(spark, str(tmp_path / "t"), "2024-10-08", "2024-10-08")
    assert back.count() == ticks.where("session = DATE'2024-10-08'").count()
    assert "PartitionFilters: [isnotnull(session" in back._jdf.queryExecution().executedPlan().toString()


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    df = spark.range(1000).selectExpr("CAST(id % 7 AS STRING) AS symbol", "DATE'2024-10-07' AS session", "id AS bar_ts")
    src.write_features(df, str(tmp_path / "b"), buckets=4, table="bucketed_features")
    plan = spark.table("bucketed_features").groupBy("symbol", "session").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_features")
    assert "Exchange" not in plan
