"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES comma-separated names, or "all" (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from tallyvine.queries import registry
from tallyvine.session import local_session

HEADLINE = [
    "campaign_totals",
    "sum_by_station",
    "mean_by_station",
    "sum_by_zone",
    "sum_by_variety",
    "mean_by_color",
    "share_by_station",
    "share_by_mode",
    "distinct_farms",
    "distinct_campaigns",
    "filter_gt",
    "filter_ne",
    "filter_count",
    "explorer_sorted",
    "row_positions",
    "row_split",
    "positional_fill",
    "keyed_fill",
    "categorical_codes",
    "delimited_scan_header",
    "hash_split",
    "knn_classify",
    "knn_accuracy",
    "knn_accuracy_by_k",
    "pca_2d",
    "batch_prediction",
    "file_completion",
    "delimited_missing",
]


def seconds(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, app="bench")
    timings = {}
    for name in names:
        seconds(queries[name], spark, folder)
        timings[name] = round(
            statistics.median(seconds(queries[name], spark, folder) for _ in range(runs)), 4
        )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
