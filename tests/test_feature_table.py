import numpy as np
import pandas as pd

from tidebook.functions.rates import bars_of_hours
from tidebook.plans.feature_table import CALENDAR, INDICATORS, feature_table


def test_feature_table_from_daily_files(spark, tmp_path):
    """Two days of one-second bars through the whole pipeline; plan has two exchanges and one sort."""
    rng = np.random.default_rng(1)
    for day in ("2024-10-07", "2024-10-08"):
        n = 3000
        offsets = np.sort(rng.integers(0, 120_000, n)) + 9 * 3_600_000 + 29 * 60_000
        index = pd.DatetimeIndex(pd.Timestamp(day) + pd.to_timedelta(offsets, unit="ms"), name="ts_event")
        bid = 100 + np.cumsum(rng.integers(-1, 2, n)) / 64
        frame = pd.DataFrame(
            {
                "action": rng.choice(list("TAC"), n),
                "side": rng.choice(list("BA"), n),
                "price": bid,
                "size": rng.integers(1, 50, n).astype("uint32"),
                "bid_px_00": bid,
                "ask_px_00": bid + rng.integers(1, 4, n) / 64,
                "bid_px_01": bid - 1,
                "ask_px_01": bid + 1,
                "bid_sz_00": rng.integers(1, 50, n).astype("uint32"),
                "ask_sz_00": rng.integers(1, 50, n).astype("uint32"),
            },
            index=index,
        )
        frame.to_parquet(tmp_path / f"AAPL_{day}_xnas-itch.parquet")
    table = feature_table(spark, str(tmp_path), "2024-10-05", "2024-10-08", rate="1s")
    rows = table.orderBy("bar_ts").collect()
    assert {r["session"].day for r in rows} == {7, 8} and len(rows) > 20
    assert all(r[c] is not None for r in rows for c in [*INDICATORS, *CALENDAR])
    assert min(r["time_since_open"] for r in rows) >= 24 and {r["is_monday"] for r in rows if r["session"].day == 7} == {1}
    assert rows[0]["bar_ts"] == pd.Timestamp("2024-10-07 09:30:00") + pd.Timedelta(seconds=rows[0]["time_since_open"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("- Sort [") == 1 and "SortAggregate" not in plan


def test_market_hours_bound_the_bars_of_a_session():
    assert bars_of_hours("1s", "09:30", "16:00") == 23_401 and bars_of_hours("1h", "09:30", "16:00") == 8
    assert bars_of_hours("200ms", "00:00", "24:00") == 432_001 and bars_of_hours("1s", "16:00", "09:30") == 0
