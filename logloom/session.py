"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every logloom job relies on. Time zone UTC makes `date_format`, `to_date` and the
# timestamp conversions independent of the machine; AQE coalesces the small shuffles of the
# summary queries and splits skewed partitions at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.compression.codec": "snappy",
    # Without this, every Column function captures the Python call stack and sends it to the
    # JVM (a few ms per call, hundreds of calls per parse plan) only to name the Python line in
    # error messages. Set it to "true" through ``conf`` when debugging a failing expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "logloom",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with logloom's defaults.

    On a cluster, leave ``master`` unset so spark-submit decides. ``shuffle_partitions``
    should be sized so one shuffle partition stays within a few hundred MB at the target
    scale; AQE coalesces it down for the small summary outputs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", settings["spark.sql.session.timeZone"])
    return spark


def scale_conf(input_bytes: int, cores: int, *, split_bytes: int = 256 << 20, max_partitions: int | None = None) -> dict[str, str]:
    """Settings sized for one job's input: ``input_bytes`` to read on ``cores`` cores.

    Input splits of ``split_bytes`` (raw text parses at a few hundred MB per core-minute, so a
    split is a task of well under a minute); shuffle partitions for the largest shuffle these
    jobs do (the optional rebalance before a write, or the distinct-count shuffle), at about
    one split each and at least two per core; AQE then merges small shuffle partitions up to
    the advisory size and splits skewed ones. ``max_partitions`` bounds the shuffle partitions
    (default: no bound).
    """
    splits = max(1, input_bytes // split_bytes)
    shuffle = max(2 * cores, splits)
    if max_partitions is not None:
        shuffle = min(shuffle, max_partitions)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
    }


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_base(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, also set as the SparkContext checkpoint dir so
    that ``DataFrame.checkpoint()`` writes there.

    The base is ``spark.checkpoint.dir`` (or the SparkContext checkpoint dir). Only in local
    mode, where every task runs on this machine, is a private temporary folder set when
    neither is configured; on a cluster a missing setting is an error, because a
    machine-local folder would not be visible to the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="logloom-")
        spark.sparkContext.setCheckpointDir(base)
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # a core setting; the SparkContext checkpoint dir now holds it
            pass
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder (see ``checkpoint_base``)."""
    return "/".join([checkpoint_base(spark).rstrip("/"), *parts, uuid.uuid4().hex])
