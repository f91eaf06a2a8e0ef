"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed, nothing collected
to the driver) after one warm-up run. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logloom import contract  # noqa: E402
from logloom.session import build_session  # noqa: E402

# The queries timed, in order. All read the whole events table of the chosen scale.
HEADLINE = [
    "top_errors_by_logger",
    "top_errors_by_source",
    "daily_summary_loggers",
    "daily_summary_sources_users",
    "hourly_error_trends_loggers",
    "hourly_error_trends_sources",
    "logger_activity_summary",
    "source_activity_summary",
    "exception_summary",
    "user_activity_summary",
    "ip_address_analysis",
    "error_summary",
    "daily_level_counts",
    "level_distribution",
    "total_count",
    "latest_rows",
    "sample_rows",
    "level_overview_recent",
    "top_error_loggers_recent",
    "http_traffic",
    "top_paths",
    "parse_access_lines",
    "access_quarantine",
    "access_table",
    "json_logs",
    "stream_ingest",
    "ingest_job",
    "ingest_single_pass",
    "aggregation_service",
    "app_summary_tables",
    "daily_summary_loggers_rollup",
    "hourly_error_trends_loggers_rollup",
    "logger_activity_summary_rollup",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app_name="logloom-bench",
        shuffle_partitions=int(cpus),
        conf={"spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    available = contract.queries()
    names = [n for n in HEADLINE if n in available]
    contract.write_raw(spark, sf_dir)  # the raw files that the ingest queries read: not timed
    run(available["top_errors_by_logger"](spark, sf_dir))  # warm-up: JVM, codegen, file listing
    times = {}
    for name in names:
        start = time.perf_counter()
        run(available[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 4)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )
    contract.clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
