"""File and table readers (raw text lines, JSON lines, curated tables, lake paths)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom import schemas
from logloom.functions.timeutil import day_literal, ingest_time
from logloom.operators import parse as parse_ops

ACCESS_GLOB = "*.log"
JSON_GLOB = "*.json"


def _join(prefix: str, glob: str) -> str:
    return prefix if not glob else prefix.rstrip("/") + "/" + glob


def spread_scan(scan: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """The scan itself, or with ``min_partitions`` its rows dealt round-robin over so many tasks:
    for unsplittable input (a handful of large ``.gz`` logs), where the per-row parsing that
    follows would keep few tasks busy. That shuffles the raw text, so it is only done when asked
    for; the plan never depends on the size of the input or of the cluster."""
    return scan.repartition(min_partitions) if min_partitions and not scan.isStreaming else scan


def read_access_lines(
    spark: SparkSession, prefix: str, glob: str = ACCESS_GLOB, min_partitions: int | None = None
) -> DataFrame:
    """Raw text lines (one ``value`` per line) of the files matching ``prefix/glob``.

    Not recursive. Files are split into ``spark.sql.files.maxPartitionBytes`` chunks, so one
    large log file is read by many tasks (uncompressed or splittable codecs);
    ``min_partitions`` spreads unsplittable input (``spread_scan``).
    """
    return spread_scan(spark.read.text(_join(prefix, glob)), min_partitions)


def read_json_logs(spark: SparkSession, prefix: str, glob: str = JSON_GLOB) -> DataFrame:
    """JSON-lines files, one record per line, parsed with the declared record schema,
    permissively: a line that is not a JSON object keeps its text in ``_corrupt_record`` and
    has NULL fields.

    The lines are read as text and parsed with ``from_json`` (the same parser as the JSON
    file reader), so the good rows and the corrupt lines can be taken from one scan.
    """
    return parse_ops.parse_json_values(read_access_lines(spark, prefix, glob))


def _or_none(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as exc:  # no file matches the glob
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None
        raise


def read_records(
    spark: SparkSession,
    prefix: str,
    *,
    prefer: str = "both",
    allow_dash_size: bool = False,
    ingest_ts: dt.datetime | str | None = None,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
    observation: Observation | None = None,
):
    """Access lines and JSON lines under ``prefix`` to parsed records, one per input line,
    with ``_reason`` (NULL for a good record), ``_raw`` and ``_format``; and the ingestion-time
    column. ``read_logs`` splits them into the two outputs.

    ``prefer="both"`` (default) parses both kinds and unions them. ``prefer="apache"`` keeps
    the older rule: JSON files are read only when there is no access line at all (this costs
    one small job to look for a first line). Raises when neither kind of file exists. With
    ``observation``, the first job that runs a plan built on the records also counts all
    input lines (``lines``) and the quarantined ones (``quarantined``).
    """
    lines = _or_none(lambda: read_access_lines(spark, prefix, access_glob))
    values = _or_none(lambda: read_access_lines(spark, prefix, json_glob))
    if prefer == "apache" and lines is not None and not lines.isEmpty():
        values = None
    elif prefer not in ("both", "apache"):
        raise ValueError(f"prefer must be 'both' or 'apache', not {prefer!r}")
    if lines is None and values is None:
        raise FileNotFoundError(f"no {access_glob} or {json_glob} files under {prefix}")
    ingest = ingest_time(ingest_ts)
    records = tagged_records(lines, values, ingest, allow_dash_size=allow_dash_size)
    if observation is not None:
        records = parse_ops.count_lines(records, observation)
    return records, ingest


def tagged_records(
    lines: DataFrame | None, values: DataFrame | None, ingest: Column, *, allow_dash_size: bool = False
) -> DataFrame:
    """Access lines and JSON text lines (either may be None; batch or stream) to the union of
    their parsed records, each with ``_format`` naming its reader."""
    parts = []
    if lines is not None:
        recs = parse_ops.access_records(lines, allow_dash_size=allow_dash_size)
        parts.append(recs.withColumn(parse_ops.FORMAT, F.lit(parse_ops.FORMAT_ACCESS)))
    if values is not None:
        recs = parse_ops.json_records(parse_ops.parse_json_values(values), ingest)
        parts.append(recs.withColumn(parse_ops.FORMAT, F.lit(parse_ops.FORMAT_JSON)))
    return reduce(DataFrame.unionByName, parts)


def read_outcome(
    spark: SparkSession, path: str, outcome: str = parse_ops.OUTCOME_LOGS, logs_schema: StructType = schemas.LOGS_APP
) -> DataFrame:
    """One side of a folder written in the single-pass layout (partitioned by ``outcome``): the
    good rows in ``logs_schema`` (``LOGS_APP``, or ``STREAM_LOGS`` for the value stream) for
    ``outcome="logs"``, or the quarantine with its day (``"rejects"``). Reading the folder
    itself, not the ``outcome=…`` subfolder, keeps a stream sink's commit log in force, and the
    ``outcome`` filter prunes to one subfolder."""
    schema = StructType([*logs_schema.fields, *schemas.QUARANTINE.fields, StructField(parse_ops.OUTCOME, StringType(), True)])
    side = spark.read.schema(schema).parquet(path).where(F.col(parse_ops.OUTCOME) == outcome)
    shape = logs_schema if outcome == parse_ops.OUTCOME_LOGS else schemas.QUARANTINE_BY_DATE
    return side.select(*[f.name for f in shape.fields])


def read_logs(
    spark: SparkSession,
    prefix: str,
    *,
    prefer: str = "both",
    allow_dash_size: bool = False,
    ingest_ts: dt.datetime | str | None = None,
    access_glob: str = ACCESS_GLOB,
    json_glob: str = JSON_GLOB,
    observation: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Access lines and JSON lines under ``prefix`` to (``LOGS_APP`` rows, quarantine); see
    ``read_records`` for the options."""
    records, ingest = read_records(
        spark, prefix, prefer=prefer, allow_dash_size=allow_dash_size, ingest_ts=ingest_ts,
        access_glob=access_glob, json_glob=json_glob, observation=observation,
    )
    good, bad = parse_ops.split_quarantine(records)
    return parse_ops.to_logs_app(good, ingest), bad


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table (Parquet, or Iceberg when its catalog is configured)."""
    return spark.table(name)


def read_lake(
    spark: SparkSession,
    path: str,
    *,
    date_column: str = schemas.LOGS_APP_PARTITION,
    days: int | None = None,
    as_of: dt.date | str | None = None,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """A partitioned table read straight from its folder. With ``days``, only the partitions
    of the last ``days`` days (up to ``as_of``) are listed and read (partition pruning).
    A declared ``schema`` (including the partition column) saves the schema-inference job."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if days is not None:
        df = df.where(F.col(date_column) >= F.date_sub(day_literal(as_of), days))
    return df
