"""Command-line jobs, for ``spark-submit`` or ``python -m logloom``.

    python -m logloom ingest RAW_PREFIX analytics.logs [--quarantine analytics.rejects] [--prefer both|apache]
    python -m logloom ingest RAW_PREFIX analytics.logs --quarantine analytics.rejects --single-pass ROOT
    python -m logloom files RAW_PREFIX analytics.logs LEDGER_PATH [--archive PATH] [--max-files 1000]
    python -m logloom incremental RAW_PREFIX SINK_PATH CHECKPOINT [--quarantine PATH | --single-pass]
    python -m logloom stream SOURCE_PATH SINK_PATH CHECKPOINT [--format text|kafka] [--option k=v ...] [--trigger "30 seconds"] [--quarantine PATH | --single-pass]
    python -m logloom generate analytics.service_logs [--rows 1000]
    python -m logloom aggregate analytics.logs analytics [--script FILE | --kind app|service [--shared-scan] | --fallback app|service]
    python -m logloom refresh analytics.logs analytics [--kind app|service] [--days 1 | --all-days] [--rollup]
    python -m logloom report analytics.logs

Exit status is 0 on success and 1 on failure. Cluster settings come from spark-submit.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from logloom.session import build_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom")
    sub = p.add_subparsers(dest="command", required=True)

    a = sub.add_parser("ingest", help="parse raw access/JSON logs and append them to a table")
    a.add_argument("raw_prefix")
    a.add_argument("table")
    a.add_argument("--quarantine")
    a.add_argument("--prefer", default="both", choices=["both", "apache"])
    a.add_argument("--allow-dash-size", action="store_true")
    a.add_argument("--format", default="parquet", help="table format, e.g. iceberg where its catalog is configured")
    a.add_argument("--rebalance", action="store_true", help="regroup rows by date before writing (one shuffle, fuller files)")
    a.add_argument("--drop-rejects", action="store_true", help="only count rejected lines (default: TABLE_rejects)")
    a.add_argument("--single-pass", metavar="ROOT",
                   help="write both tables in one pass, stored side by side under ROOT (needs --quarantine)")

    a.add_argument("--batch-id", help="repeatable: rows of an earlier run of this batch are replaced")

    a = sub.add_parser("files", help="ingest the files that the ledger does not know, in repeatable batches")
    a.add_argument("raw_prefix")
    a.add_argument("table")
    a.add_argument("ledger")
    a.add_argument("--quarantine")
    a.add_argument("--archive", help="move the files of finished batches here")
    a.add_argument("--max-files", type=int, default=1000)
    a.add_argument("--allow-dash-size", action="store_true")

    a = sub.add_parser("incremental", help="ingest only raw files not seen by an earlier run")
    a.add_argument("raw_prefix")
    a.add_argument("sink_path")
    a.add_argument("checkpoint")
    a.add_argument("--quarantine")
    a.add_argument("--drop-rejects", action="store_true", help="do not store rejected lines (default: SINK_PATH_rejects)")
    a.add_argument("--max-files-per-trigger", type=int)
    a.add_argument("--single-pass", action="store_true",
                   help="one query writes logs and rejects under SINK_PATH, partitioned by outcome")

    a = sub.add_parser("stream", help="continuous ingest of JSON log values")
    a.add_argument("source", nargs="?")
    a.add_argument("sink_path")
    a.add_argument("checkpoint")
    a.add_argument("--format", default="text")
    a.add_argument("--option", action="append", default=[], help="source option key=value")
    a.add_argument("--trigger", default="30 seconds")
    a.add_argument("--quarantine")
    a.add_argument("--drop-rejects", action="store_true", help="do not store rejected values (default: SINK_PATH_rejects)")
    a.add_argument("--single-pass", action="store_true",
                   help="one query writes logs and rejects under SINK_PATH, partitioned by outcome")

    a = sub.add_parser("generate", help="append generated service-log rows and report")
    a.add_argument("table")
    a.add_argument("--rows", type=int, default=1000)
    a.add_argument("--seed", type=int, default=0)

    a = sub.add_parser("aggregate", help="build the summary tables of a database")
    a.add_argument("source_table")
    a.add_argument("database")
    a.add_argument("--script", help="SQL file run statement by statement")
    a.add_argument("--kind", choices=["app", "service"])
    a.add_argument("--fallback", choices=["app", "service"], default="service",
                   help="tables built (if absent) when neither --script nor --kind is given")
    a.add_argument("--format", default="parquet")
    a.add_argument("--shared-scan", action="store_true",
                   help="with --kind: build the daily, hourly and per-logger or per-source summaries from the stored rollup")

    a = sub.add_parser("refresh", help="recompute the date-grouped summaries of the last days")
    a.add_argument("source_table")
    a.add_argument("database")
    a.add_argument("--kind", choices=["app", "service"], default="service")
    a.add_argument("--days", type=int, default=1)
    a.add_argument("--all-days", action="store_true", help="with --rollup: build it from the whole table")
    a.add_argument("--rollup", action="store_true", help="daily, hourly and per-member summaries from the stored rollup")
    a.add_argument("--as-of", help="last day, yyyy-mm-dd (default: today)")
    a.add_argument("--format", default="parquet")

    a = sub.add_parser("report", help="print a table check")
    a.add_argument("table")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session(app_name=f"logloom-{args.command}")
    start = time.time()
    ok = True
    if args.command == "ingest":
        from logloom.plans.pipelines import ingest_logs, ingest_logs_single_pass

        if args.single_pass:
            if not args.quarantine:
                raise SystemExit("--single-pass needs --quarantine")
            if args.format != "parquet" or args.drop_rejects or args.batch_id:
                raise SystemExit("--single-pass stores Parquet, rejects included, without batch ids")
            res = ingest_logs_single_pass(
                spark, args.raw_prefix, args.table, args.quarantine, args.single_pass, prefer=args.prefer,
                allow_dash_size=args.allow_dash_size, rebalance=args.rebalance,
            )
        else:
            res = ingest_logs(
                spark, args.raw_prefix, args.table, prefer=args.prefer, allow_dash_size=args.allow_dash_size,
                quarantine_table=args.quarantine, fmt=args.format, rebalance=args.rebalance, keep_rejects=not args.drop_rejects,
                batch_id=args.batch_id,
            )
        print(json.dumps({"rows_written": res.rows_written, "rows_quarantined": res.rows_quarantined}))
    elif args.command == "files":
        from logloom.plans.batches import ingest_new_files

        done = ingest_new_files(
            spark, args.raw_prefix, args.table, args.ledger, max_files=args.max_files, rejects=args.quarantine,
            archive=args.archive, allow_dash_size=args.allow_dash_size,
        )
        print(json.dumps({"batches": len(done), "files": sum(d.files for d in done), "rows_written": sum(d.rows for d in done),
                          "rows_quarantined": sum(d.rejects for d in done)}))
    elif args.command == "incremental":
        from logloom.streaming.ingest import incremental_ingest

        incremental_ingest(
            spark, args.raw_prefix, args.sink_path, args.checkpoint, quarantine_path=args.quarantine,
            max_files_per_trigger=args.max_files_per_trigger, single_pass=args.single_pass, keep_rejects=not args.drop_rejects,
        )
    elif args.command == "stream":
        from logloom.streaming.ingest import stream_source, streaming_ingest

        options = dict(o.split("=", 1) for o in args.option)
        values = stream_source(spark, args.source, fmt=args.format, options=options)
        for q in streaming_ingest(
            values, args.sink_path, args.checkpoint, trigger=args.trigger, quarantine_path=args.quarantine,
            single_pass=args.single_pass, keep_rejects=not args.drop_rejects,
        ):
            q.awaitTermination()
    elif args.command == "generate":
        from logloom.plans.pipelines import ingest_service_logs

        rep = ingest_service_logs(spark, args.table, args.rows, seed=args.seed)
        print(json.dumps({"rows_written": rep.rows_written, "total_records": rep.total_records,
                          "levels": rep.level_distribution}))
    elif args.command == "aggregate":
        from logloom.plans.pipelines import run_aggregation

        script = Path(args.script).read_text() if args.script else None
        res = run_aggregation(
            spark, args.source_table, args.database, script=script, kind=args.kind, fallback=args.fallback,
            shared_scan=args.shared_scan, fmt=args.format,
        )
        ok = res.success
        print(json.dumps({
            "success": res.success, "source_rows": res.source_rows, "tables": res.table_counts,
            "failed_statements": [s.statement_index for s in res.statements if not s.success],
        }))
    elif args.command == "refresh":
        from logloom.plans.pipelines import refresh_daily_summaries
        from logloom.plans.rollups import refresh_summaries

        if args.rollup:
            days = None if args.all_days else args.days
            print(json.dumps({"tables": refresh_summaries(spark, args.source_table, args.database, kind=args.kind, days=days, as_of=args.as_of)}))
        else:
            print(json.dumps({"tables": refresh_daily_summaries(
                spark, args.source_table, args.database, kind=args.kind, days=args.days, as_of=args.as_of, fmt=args.format
            )}))
    elif args.command == "report":
        from logloom.plans.pipelines import table_report

        for name, frame in table_report(spark, args.table).items():
            print(f"-- {name}")
            frame.show(truncate=False)
    print(json.dumps({"command": args.command, "seconds": round(time.time() - start, 2), "success": ok}), file=sys.stderr)
    spark.stop()
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
