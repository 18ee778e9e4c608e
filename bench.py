"""Time the headline queries: one JSON line with seconds per query and in total.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. Every query runs once to warm the JVM up on the
smallest tables, then once timed, with all of its rows computed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from checks.registry import CHECKS

QUERIES = [
    "column_profile",
    "device_type_stats",
    "combine_sources",
    "device_event_map",
    "potential_pairs",
    "pivot_object_payload",
    "object_by_window_mean_60",
    "object_by_window_median_1440",
    "object_at_events",
    "event_closest_mapped",
    "event_closest_by_time",
    "event_mean_mapped_60",
    "event_mean_by_time_30",
    "event_median_mapped_1440",
    "insert_object_attributes",
    "log_overview",
    "activities_per_object_type",
    "directly_follows",
    "start_and_end_activities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        CHECKS[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in QUERIES:
            run(name, warm)
    seconds = {name: run(name, sf_dir) for name in QUERIES}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
