"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm the JVM up and once timed, to a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from checks.queries import REGISTRY  # noqa: E402
from tidebook.operators.bars import dense_grid  # noqa: E402
from tidebook.plans.feature_table import bar_features, features_of  # noqa: E402
from tidebook.session import spark_session  # noqa: E402
from tidebook.sources.ticks import event_ticks  # noqa: E402

REGISTERED = [
    "market_hours",
    "label_next_bar",
    "chrono_split",
    "sequences_scaled",
    "standard_global",
    "describe",
    "correlation",
    "mutual_info",
    "ensemble_vote",
    "class_report",
    "acf",
    "adf",
    "arima_walk_forward",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    one, ten = event_ticks(spark, folder, 1), event_ticks(spark, folder, 10)
    runs: dict[str, Callable[[], DataFrame]] = {
        "bars_5min": lambda: bar_features(one, "5min"),
        "bars_30min_10_symbols": lambda: bar_features(ten, "30min"),
        "grid_5min": lambda: dense_grid(one, "5min"),
        "features_5min": lambda: features_of(one, "5min"),
        "features_30min_10_symbols": lambda: features_of(ten, "30min"),
    }
    runs |= {name: lambda name=name: REGISTRY[name][0](spark, folder) for name in REGISTERED}
    seconds: dict[str, float] = {}
    for name, make in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))
    spark.stop()


if __name__ == "__main__":
    main()
