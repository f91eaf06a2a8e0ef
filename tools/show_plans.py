"""Print the key lines of the physical plan of every summary query over a stored,
date-partitioned Parquet log table, and of the access-line parse.

Usage: python tools/show_plans.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

KEEP = re.compile(r"^\(\d+\) |PushedFilters|PartitionFilters|ReadSchema|^Keys|^Functions|^Arguments: \d")


def key_lines(df) -> list[str]:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    lines = [ln for ln in buf.getvalue().splitlines() if KEEP.search(ln)]
    return [ln if len(ln) < 240 else ln[:237] + "..." for ln in lines]


def _single_pass_rows(spark, sf_dir):
    from logloom.functions.timeutil import ingest_time
    from logloom.operators import parse as parse_ops
    from logloom.sources.events import event_access_lines, read_events
    from logloom.sources.files import tagged_records

    ingest = ingest_time("2024-01-31 00:00:00")
    lines = event_access_lines(read_events(spark, sf_dir))
    return parse_ops.outcome_rows(tagged_records(lines, None, ingest), ingest)


def main() -> None:
    from logloom import contract
    from logloom.operators import summaries as Q
    from logloom.session import build_session, shared_dir

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = shared_dir(spark, "logloom-plans")
    contract.logs(spark, sf_dir).write.partitionBy("partition_date").parquet(folder + "/app")
    contract.access_logs(spark, sf_dir).write.partitionBy("partition_date").parquet(folder + "/access")
    logs = spark.read.parquet(folder + "/app")
    access = spark.read.parquet(folder + "/access")
    as_of = contract.AS_OF
    cases = {
        "Q1 top_errors_by_logger": Q.top_errors_by_logger(logs),
        "Q4 daily_summary_sources_users": Q.daily_summary_sources_users(logs),
        "Q5 hourly_error_trends_loggers": Q.hourly_error_trends_loggers(logs),
        "Q7 logger_activity_summary": Q.logger_activity_summary(logs),
        "Q9 exception_summary": Q.exception_summary(logs),
        "Q10 user_activity_summary": Q.user_activity_summary(logs),
        "Q16 latest_rows": Q.latest_rows(logs, columns=contract.LOG_COLUMNS),
        "Q18 level_overview_recent": Q.level_overview_recent(logs, as_of=as_of),
        "Q19 top_error_loggers_recent": Q.top_error_loggers_recent(logs, as_of=as_of),
        "Q20 http_traffic": Q.http_traffic(access, as_of=as_of),
        "Q22 top_paths": Q.top_paths(access),
        "Q3/Q5/Q7 shared scan: hourly_logger_rollup": Q.hourly_logger_rollup(logs),
        "P1-P15 parse_access_lines (from raw lines)": contract.access_logs(spark, sf_dir),
        "J1 single pass: logs and rejects as one set of rows (from raw lines)": _single_pass_rows(spark, sf_dir),
    }
    print("# Physical plans (key lines)\n")
    print("Generated by `tools/show_plans.py`: summary queries over a stored Parquet log table partitioned by")
    print("`partition_date` (as in production), and the access-line parse. AQE re-plans at run time.\n")
    for name, df in cases.items():
        print(f"## {name}\n\n```")
        print("\n".join(key_lines(df)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
