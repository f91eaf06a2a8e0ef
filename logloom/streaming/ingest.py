"""Streaming ingest with Structured Streaming.

The parsers of ``logloom.operators.parse`` are plain DataFrame transformations, so the same
code runs on a stream. File sinks are exactly-once (the sink keeps a log of committed
files next to the checkpoint).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from logloom import schemas
from logloom.functions.normalize import day_of, iso_instant
from logloom.functions.timeutil import ingest_time, utc_wall_clock
from logloom.operators import parse as parse_ops
from logloom.sources.files import ACCESS_GLOB, JSON_GLOB, tagged_records

WATERMARK_DELAY = "10 minutes"
STREAM_PARTITION = "partition_date"
# Files older than this (against the newest one seen) are skipped by a file stream: in effect none.
MAX_FILE_AGE = "36500d"
REJECTS_SUFFIX = "_rejects"


def stream_source(
    spark: SparkSession,
    path: str | None = None,
    *,
    fmt: str = "text",
    options: Mapping[str, str] | None = None,
    max_file_age: str = MAX_FILE_AGE,
) -> DataFrame:
    """A stream of text values (``value`` column).

    ``fmt="text"``: new files in a folder (glob allowed), whatever their age: Spark's own
    default skips files a week older than the newest one seen, so ``max_file_age`` is set. ``fmt="kafka"``: a topic, given by
    ``options`` such as ``kafka.bootstrap.servers`` and ``subscribe`` (needs the Kafka
    connector on the classpath); the record value is read as UTF-8 text.
    """
    reader = spark.readStream.format(fmt)
    if fmt != "kafka":
        reader = reader.option("maxFileAge", max_file_age)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    df = reader.load(path) if path is not None else reader.load()
    if fmt == "kafka":
        return df.select(F.col("value").cast("string").alias("value"))
    return df


def parse_stream_values(
    values: DataFrame, *, watermark: str | None = WATERMARK_DELAY, ingest_ts: dt.datetime | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """JSON values to (``STREAM_LOGS`` rows: ``STREAM_VALUE`` + ``partition_date``, quarantine).

    The rules are those of the batch parse: blank values are skipped, a missing time becomes
    the ingest time, an unreadable one stays NULL and its row lands in the ingest day's partition.
    The watermark is declared on the event time (a zoned timestamp, as watermarks need);
    the stored ``timestamp`` is then the UTC wall-clock ``timestamp_ntz`` of the batch
    tables. With no stateful operator after it, the watermark drops nothing.
    """
    records = stream_records(values, watermark=watermark, ingest_ts=ingest_ts).drop(parse_ops.FORMAT)
    return parse_ops.split_quarantine(records, parse_ops.FORMAT_JSON)


def stream_records(
    values: DataFrame, *, watermark: str | None = WATERMARK_DELAY, ingest_ts: dt.datetime | str | None = None
) -> DataFrame:
    """JSON values to ``STREAM_LOGS`` records, one per non-blank value, with ``_raw``, ``_reason``
    and ``_format`` (see ``parse_stream_values``)."""
    text = [StructField(f.name, StringType(), True) for f in schemas.STREAM_VALUE.fields]
    schema = StructType([*text, StructField(schemas.CORRUPT_COLUMN, StringType(), True)])
    now = F.current_timestamp() if ingest_ts is None else F.concat(F.lit(str(ingest_ts)), F.lit("+00:00")).cast("timestamp")
    parsed = parse_ops.read_json_text(values, schema, keep=("value",)).withColumn(
        "timestamp", F.when(F.col("timestamp").isNull(), now).otherwise(iso_instant(F.col("timestamp")))
    )
    if watermark:
        parsed = parsed.withWatermark("timestamp", watermark)
    corrupt = F.col(schemas.CORRUPT_COLUMN)
    records = parsed.select(
        utc_wall_clock(F.col("timestamp")).alias("timestamp"),
        *[F.col(f.name) for f in schemas.STREAM_VALUE.fields if f.name != "timestamp"],
        F.col("value").alias(parse_ops.RAW),
        F.when(corrupt.isNotNull(), F.lit(parse_ops.CORRUPT_JSON)).alias(parse_ops.REASON),
        F.lit(parse_ops.FORMAT_JSON).alias(parse_ops.FORMAT),
    )
    return records.withColumn(STREAM_PARTITION, day_of(F.col("timestamp"), ingest_time(ingest_ts)))


def _start(
    df: DataFrame,
    sink_path: str,
    checkpoint: str,
    *,
    trigger: str | None,
    fmt: str,
    partition_by: tuple[str, ...] = (),
    name: str | None = None,
) -> StreamingQuery:
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    if trigger is None or trigger == "availableNow":
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=trigger)
    return writer.start(sink_path)


def streaming_ingest(
    values: DataFrame,
    sink_path: str,
    checkpoint: str,
    *,
    trigger: str | None = "30 seconds",
    fmt: str = "parquet",
    quarantine_path: str | None = None,
    watermark: str | None = WATERMARK_DELAY,
    single_pass: bool = False,
    keep_rejects: bool = True,
    ingest_ts: dt.datetime | str | None = None,
) -> list[StreamingQuery]:
    """Start the stream: JSON values -> parsed rows -> ``sink_path`` partitioned by
    ``partition_date``. ``trigger`` is a processing-time interval, or ``"availableNow"`` /
    None to process what is there and stop. Corrupt values go to ``quarantine_path`` (default:
    next to the sink, ``<sink>_rejects``) by a second query (own checkpoint below ``checkpoint``),
    which reads the source again; ``keep_rejects=False`` leaves them out.
    ``single_pass=True`` instead writes both sides in one query to ``sink_path``,
    partitioned by ``outcome`` and ``partition_date`` (a corrupt value's day is the
    processing day); read a side with ``sources.files.read_outcome(...,
    logs_schema=schemas.STREAM_LOGS)``. Returns the started queries."""
    ck = checkpoint.rstrip("/")
    if single_pass:
        if quarantine_path:
            raise ValueError("single_pass writes the rejects under sink_path; give no quarantine_path")
        names = [f.name for f in schemas.STREAM_LOGS.fields]
        rows = parse_ops.with_outcome(
            stream_records(values, watermark=watermark, ingest_ts=ingest_ts), names, STREAM_PARTITION, F.to_date(ingest_time(ingest_ts))
        )
        parts = (parse_ops.OUTCOME, STREAM_PARTITION)
        return [_start(rows, sink_path, f"{ck}/all", trigger=trigger, fmt=fmt, partition_by=parts)]
    good, bad = parse_stream_values(values, watermark=watermark, ingest_ts=ingest_ts)
    queries = [_start(good, sink_path, f"{ck}/logs", trigger=trigger, fmt=fmt, partition_by=(STREAM_PARTITION,))]
    if keep_rejects:
        quarantine_path = quarantine_path or sink_path.rstrip("/") + REJECTS_SUFFIX
        queries.append(_start(bad, quarantine_path, f"{ck}/quarantine", trigger=trigger, fmt=fmt))
    return queries


def incremental_ingest(
    spark: SparkSession,
    raw_prefix: str,
    sink_path: str,
    checkpoint: str,
    *,
    allow_dash_size: bool = False,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
    fmt: str = "parquet",
    quarantine_path: str | None = None,
    max_files_per_trigger: int | None = None,
    wait: bool = True,
    single_pass: bool = False,
    keep_rejects: bool = True,
    max_file_age: str = MAX_FILE_AGE,
    ingest_ts: dt.datetime | str | None = None,
) -> list[StreamingQuery]:
    """Ingest the raw files under ``raw_prefix`` that no earlier run has seen.

    Access and JSON files are read as file streams (the checkpoint remembers which files are
    done), parsed with the batch parsers, and appended to ``sink_path`` (``LOGS_APP``,
    partitioned by ``partition_date``) with an ``availableNow`` trigger: each run processes
    what is new, in as many micro-batches as needed, and stops. A second run over the same
    files adds nothing; a file that arrives late is read whatever its age (``max_file_age``).
    ``ingestion_timestamp`` is the micro-batch time, or ``ingest_ts``.
    ``max_files_per_trigger`` bounds one micro-batch when a large backlog has accumulated.

    The rejected lines go to ``quarantine_path`` (default: next to the sink, ``<sink>_rejects``) by
    a second query over the same files (each file is read and parsed twice);
    ``keep_rejects=False`` leaves them out. ``single_pass=True`` instead writes both in one
    query to ``sink_path``, partitioned by ``outcome`` (``logs`` / ``rejects``) and
    ``partition_date``; the sink's commit log keeps it exactly-once, and
    ``sources.files.read_outcome`` reads either side.
    """
    if single_pass and quarantine_path:
        raise ValueError("single_pass writes the rejects under sink_path; give no quarantine_path")
    base = raw_prefix.rstrip("/")
    reader = spark.readStream.option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.text(f"{base}/{access_glob}")
    values = reader.text(f"{base}/{json_glob}")
    ck = checkpoint.rstrip("/")
    if single_pass:
        ingest = ingest_time(ingest_ts)
        rows = parse_ops.outcome_rows(tagged_records(lines, values, ingest, allow_dash_size=allow_dash_size), ingest)
        parts = (parse_ops.OUTCOME, schemas.LOGS_APP_PARTITION)
        queries = [_start(rows, sink_path, f"{ck}/all", trigger="availableNow", fmt=fmt, partition_by=parts)]
        if wait:
            queries[0].awaitTermination()
        return queries
    good_a, bad_a = parse_ops.parse_access_logs(lines, allow_dash_size=allow_dash_size, ingest_ts=ingest_ts)
    good_j, bad_j = parse_ops.parse_json_logs(parse_ops.parse_json_values(values), ingest_ts=ingest_ts)
    good, bad = good_a.unionByName(good_j), bad_a.unionByName(bad_j)
    queries = [_start(good, sink_path, f"{ck}/logs", trigger="availableNow", fmt=fmt, partition_by=(schemas.LOGS_APP_PARTITION,))]
    if keep_rejects:
        quarantine_path = quarantine_path or sink_path.rstrip("/") + REJECTS_SUFFIX
        queries.append(_start(bad, quarantine_path, f"{ck}/quarantine", trigger="availableNow", fmt=fmt))
    if wait:
        for q in queries:
            q.awaitTermination()
    return queries
