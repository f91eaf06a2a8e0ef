"""Structured Streaming ingest: same results as batch, exactly once per file."""

from __future__ import annotations

import datetime as dt
import json
import os
import time

from logloom.operators import parse as P
from logloom.sources import files
from logloom.streaming import ingest as S

LINE = '10.0.0.{i} - - [25/Aug/2025:06:{i:02d}:00 +0000] "GET /p HTTP/1.1" {status} 10 "-" "-"'
REC = {"timestamp": "2025-08-25T07:00:00.000Z", "level": "ERROR", "message": "x", "logger": "a", "thread": "t"}


INGEST = "2025-09-01 12:00:00"


def _raw(path, start, n):
    path.mkdir(exist_ok=True)
    (path / f"access_{start}.log").write_text("\n".join(LINE.format(i=i, status=200 + i) for i in range(start, start + n)) + "\nbad\n")
    (path / f"app_{start}.json").write_text(json.dumps(REC) + "\n{broken\n")


def _rows(df, drop=("ingestion_timestamp",)):
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_incremental_ingest_equals_batch_and_is_exactly_once(spark, tmp_path):
    raw, sink, ck, q = tmp_path / "raw", str(tmp_path / "sink"), str(tmp_path / "ck"), str(tmp_path / "q")
    _raw(raw, 1, 5)
    S.incremental_ingest(spark, str(raw), sink, ck, quarantine_path=q)
    batch_good, batch_bad = files.read_logs(spark, str(raw))
    assert _rows(spark.read.parquet(sink)) == _rows(batch_good)
    assert _rows(spark.read.parquet(q), drop=()) == _rows(batch_bad, drop=())
    S.incremental_ingest(spark, str(raw), sink, ck, quarantine_path=q)  # nothing new
    assert spark.read.parquet(sink).count() == 6
    _raw(raw, 20, 3)  # new files only are read
    S.incremental_ingest(spark, str(raw), sink, ck, quarantine_path=q)
    assert spark.read.parquet(sink).count() == 10
    assert spark.read.parquet(q).count() == 4


def test_single_pass_incremental_ingest(spark, tmp_path):
    """One query writes both sides; each side equals the batch parse; exactly once per file."""
    raw, sink, ck = tmp_path / "raw", str(tmp_path / "sink"), str(tmp_path / "ck")
    _raw(raw, 1, 5)
    queries = S.incremental_ingest(spark, str(raw), sink, ck, single_pass=True)
    assert len(queries) == 1
    batch_good, batch_bad = files.read_logs(spark, str(raw))
    good, bad = files.read_outcome(spark, sink, P.OUTCOME_LOGS), files.read_outcome(spark, sink, P.OUTCOME_REJECTS)
    assert good.columns == batch_good.columns
    assert _rows(good) == _rows(batch_good)
    assert _rows(bad, drop=("partition_date",)) == _rows(batch_bad, drop=())
    S.incremental_ingest(spark, str(raw), sink, ck, single_pass=True)  # nothing new
    assert good.count() == 6 and bad.count() == 2
    _raw(raw, 20, 3)
    S.incremental_ingest(spark, str(raw), sink, ck, single_pass=True)
    assert files.read_outcome(spark, sink).count() == 10
    assert files.read_outcome(spark, sink, P.OUTCOME_REJECTS).count() == 4


def test_streaming_ingest_values(spark, tmp_path):
    src = tmp_path / "values"
    src.mkdir()
    recs = [REC, {**REC, "timestamp": "2025-08-25T07:00:00+05:30", "level": "INFO"}, {"level": "WARN"}]
    (src / "v.txt").write_text("\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    sink, ck, q = str(tmp_path / "sink"), str(tmp_path / "ck"), str(tmp_path / "q")
    values = S.stream_source(spark, str(src))
    for query in S.streaming_ingest(values, sink, ck, trigger="availableNow", quarantine_path=q, ingest_ts=INGEST):
        query.awaitTermination()
    out = {r["level"]: r for r in spark.read.parquet(sink).collect()}
    assert out["ERROR"]["timestamp"] == dt.datetime(2025, 8, 25, 7) and out["ERROR"]["partition_date"] == dt.date(2025, 8, 25)
    assert out["INFO"]["timestamp"] == dt.datetime(2025, 8, 25, 1, 30)
    assert out["WARN"]["timestamp"] == dt.datetime(2025, 9, 1, 12)  # no time: the ingest time, as in batch
    bad = spark.read.parquet(q).collect()
    assert [(r["value"], r["reason"]) for r in bad] == [("not json", P.CORRUPT_JSON)]


def test_streaming_ingest_values_single_pass(spark, tmp_path):
    """One query writes both sides; each equals the two-query output."""
    from logloom import schemas

    src = tmp_path / "values"
    src.mkdir()
    recs = [REC, {**REC, "timestamp": "2025-08-25T07:00:00+05:30", "level": "INFO"}, {"level": "WARN"}]
    (src / "v.txt").write_text("\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    two, ck2, q = str(tmp_path / "two"), str(tmp_path / "ck2"), str(tmp_path / "q")
    for query in S.streaming_ingest(S.stream_source(spark, str(src)), two, ck2, trigger="availableNow", quarantine_path=q, ingest_ts=INGEST):
        query.awaitTermination()
    one, ck1 = str(tmp_path / "one"), str(tmp_path / "ck1")
    queries = S.streaming_ingest(S.stream_source(spark, str(src)), one, ck1, trigger="availableNow", single_pass=True, ingest_ts=INGEST)
    assert len(queries) == 1
    queries[0].awaitTermination()
    good = files.read_outcome(spark, one, P.OUTCOME_LOGS, logs_schema=schemas.STREAM_LOGS)
    bad = files.read_outcome(spark, one, P.OUTCOME_REJECTS, logs_schema=schemas.STREAM_LOGS)
    assert good.columns == [f.name for f in schemas.STREAM_LOGS.fields]
    assert _rows(good, drop=()) == _rows(spark.read.parquet(two), drop=())
    assert _rows(bad, drop=("partition_date",)) == _rows(spark.read.parquet(q), drop=())


def test_watermark_is_declared(spark, tmp_path):
    (tmp_path / "v.txt").write_text(json.dumps(REC) + "\n")
    good, _ = S.parse_stream_values(S.stream_source(spark, str(tmp_path)))
    assert good.isStreaming
    assert "EventTimeWatermark" in good._jdf.queryExecution().logical().toString()


def test_processing_time_trigger_picks_up_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(json.dumps(REC) + "\n")
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    queries = S.streaming_ingest(S.stream_source(spark, str(src)), sink, ck, trigger="1 second")
    try:
        for query in queries:
            query.processAllAvailable()
        (src / "b.txt").write_text(json.dumps({**REC, "level": "INFO"}) + "\nbroken\n")
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    assert [r.value for r in spark.read.parquet(sink + S.REJECTS_SUFFIX).collect()] == ["broken"]
    assert sorted(r["level"] for r in spark.read.parquet(sink).collect()) == ["ERROR", "INFO"]


def test_late_files_and_rejects_are_kept_by_default(spark, tmp_path):
    """A file dated weeks before those already read is read; rejects are stored next to the sink."""
    raw, sink, ck = tmp_path / "raw", str(tmp_path / "sink"), str(tmp_path / "ck")
    _raw(raw, 1, 2)
    S.incremental_ingest(spark, str(raw), sink, ck)
    _raw(raw, 30, 2)
    old = time.time() - 30 * 86400
    for name in ("access_30.log", "app_30.json"):
        os.utime(raw / name, (old, old))
    S.incremental_ingest(spark, str(raw), sink, ck)
    assert spark.read.parquet(sink).count() == 6
    assert spark.read.parquet(sink + S.REJECTS_SUFFIX).count() == 4


def test_stream_follows_the_batch_rules(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "v.txt").write_text("\n".join(["", "  ", "null", '{"message": "no time"}', '{"message": "bad time", "timestamp": "x"}', json.dumps(REC)]) + "\n")
    sink = str(tmp_path / "sink")
    for query in S.streaming_ingest(S.stream_source(spark, str(src)), sink, str(tmp_path / "ck"), trigger=None, ingest_ts=INGEST):
        query.awaitTermination()
    got = {r.message: (r.timestamp, r.partition_date) for r in spark.read.parquet(sink).collect()}
    day = dt.date(2025, 9, 1)
    assert got == {"no time": (dt.datetime(2025, 9, 1, 12), day), "bad time": (None, day), "x": (dt.datetime(2025, 8, 25, 7), dt.date(2025, 8, 25))}
    assert [r.value for r in spark.read.parquet(sink + S.REJECTS_SUFFIX).collect()] == ["null"]
