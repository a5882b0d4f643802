"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from tidemark.catalog import catalog

HEADLINE = (
    "dead_letters",
    "edits_parsed",
    "deduplicated_log",
    "filter_decisions",
    "labels_72h",
    "filter_trade_off",
    "next_error_after_purchase",
    "returned_orders",
    "score_grid",
    "calibration_by_segment",
    "routing_policies",
    "band_search",
    "drift_checks",
    "rate_per_second",
    "load_windows_30_minutes",
    "backlog_series",
    "exactly_once_audit",
    "page_text",
    "seeded_sample",
    "stream_counts_per_minute",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    # The first parse of a session compiles; it is not what the figures are about.
    queries["edits_parsed"][0](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Building counts as well: some queries store intermediate tables first.
        queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
