"""Spark session defaults and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for epoch maths, AQE for
# runtime re-planning (coalescing small shuffles, splitting skewed ones).
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for very large inputs (tens of TB): larger scan splits and
# post-shuffle partitions so task counts stay in the tens of thousands; AQE
# then coalesces small partitions and splits skewed ones at run time.
SCALE_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 * 1024 * 1024,
                           floor: int = 200, ceiling: int = 100_000) -> int:
    """Initial shuffle width for an input size; AQE coalesces from there."""
    return max(floor, min(ceiling, -(-int(input_bytes) // target_bytes)))


def apply_scale_conf(spark: SparkSession, input_bytes: int | None = None) -> None:
    """Apply ``SCALE_CONF`` (and a shuffle width sized from the input) to a session."""
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    if input_bytes:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes)))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a
    cluster the submitter decides both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(CORE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_sql_defaults(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings that must hold for correct results."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is
    unset and the master is local a scratch folder is created and registered;
    on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: executors of a cluster need a shared folder")
    if not path:
        path = tempfile.mkdtemp(prefix="revlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
