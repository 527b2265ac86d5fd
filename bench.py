"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times for the median.  Results go to
the no-op sink, so the whole plan runs and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stratafold.registry.queries import QUERIES
from stratafold.session import build_session

HEADLINE = (
    "scd2_history",
    "scd2_two_batches",
    "dedup_keep_latest",
    "upsert_newest_wins",
    "pit_join_closed",
    "pit_join_half_open",
    "top_customers_window",
    "first_response_time",
    "cohort_retention",
    "check_uniqueness",
    "check_referential",
    "check_volume",
    "quality_report",
    "raw_roundtrip",
    "batch_replace",
    "scd2_two_step",
    "silver_upsert_by_day",
    "stream_to_silver",
    "gated_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
