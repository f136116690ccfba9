"""Stateful stream monitors and progress snapshots (T2s, T3s, T4s, T5s).

Label counters hold one row per label (complete mode, ``start_snapshot_query``).
Throughput windows run in append mode (``start_append_query``): a window is written
once, when the watermark has passed its end, and its state is dropped, so the
state holds only the open windows however long the query runs. (In complete
mode Spark would keep every window.)
"""

from __future__ import annotations

import datetime as _dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from revlens.schemas import OFFSET_SNAPSHOT, PREDICTION
from revlens.streaming.scoring import batch_path, committed, run_name


def label_counters(scored: DataFrame) -> DataFrame:
    """T4s: running count per label (complete output mode; state = one row per label)."""
    return scored.groupBy(F.coalesce("sentiment_label", F.lit("unknown")).alias("label")).count()


def throughput_stream(stream: DataFrame, ts_col: str = "inserted_at", width: str = "60 seconds",
                      slide: str = "10 seconds", watermark: str = "2 minutes") -> DataFrame:
    """T5s: rows per sliding window of ingest time, finalised after the watermark (any output mode)."""
    ts = F.col(ts_col).cast("timestamp")
    return (stream.withColumn("_ts", ts).withWatermark("_ts", watermark)
            .groupBy(F.window("_ts", width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def closed_throughput(stream: DataFrame, ts_col: str = "inserted_at", width: str = "60 seconds",
                      slide: str = "10 seconds", watermark: str = "2 minutes") -> DataFrame:
    """T5s in append mode: the windows of ``throughput_stream`` that the watermark has closed.

    Rows are counted once, in windows of one slide; only these counts go on, by their window's
    time, into the sliding windows that hold them, so that an event is one row for the state and not
    one for each of its windows. ``width`` is a whole number of slides.
    """
    buckets = (stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
               .groupBy(F.window("_ts", slide).alias("b")).agg(F.count(F.lit(1)).alias("k")))
    return (buckets.groupBy(F.window(F.window_time("b"), width, slide).alias("w")).agg(F.sum("k").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def tail_predictions(spark: SparkSession, table_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """T3s: new rows of the stored prediction table as a stream (no id cursor needed:
    the file source remembers which files it has delivered)."""
    schema = StructType(PREDICTION.fields + [StructField("run", StringType(), True), StructField("batch_id", LongType(), True)])
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(table_path)


def start_counters(scored: DataFrame, checkpoint: str, query_name: str = "label_counters",
                   available_now: bool = False):
    """Run T4s into an in-memory table (for a dashboard process)."""
    w = (label_counters(scored).writeStream.outputMode("complete").format("memory")
         .queryName(query_name).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def write_snapshot_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One complete-mode micro-batch -> ``path/batch_id=<id>``, written by the executors.

    Overwrite makes a replayed batch replace its own output; earlier batch
    folders stay readable while a newer one is being written.
    """
    batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def start_snapshot_query(result: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                         trigger: str = "1 second"):
    """Run a stateful aggregate in complete mode into a versioned parquet table.

    Unlike the memory sink, the result never passes through the driver, so the
    number of windows or keys in the state is not bounded by driver memory.
    """
    w = (result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: write_snapshot_batch(b, i, path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def write_closed_batch(batch: DataFrame, batch_id: int, path: str, run: str) -> None:
    """One append-mode micro-batch -> ``path/run=<run>/batch_id=<id>``; a committed batch is skipped when replayed."""
    target = batch_path(path, run, batch_id)
    if not committed(batch.sparkSession, target):
        batch.write.mode("overwrite").parquet(target)


def start_append_query(result: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                       trigger: str = "10 seconds"):
    """Run a watermarked aggregate in append mode into a parquet table: each closed window is stored once.

    As in the stats sink the run's name lives in the checkpoint, so neither a
    restart nor a second query replaces or repeats stored windows.
    """
    run = run_name(result.sparkSession, checkpoint)
    w = (result.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: write_closed_batch(b, i, path, run)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    """The closed windows written by ``start_append_query``."""
    return spark.read.parquet(path).drop("run", "batch_id")


def state_rows(query) -> list[int]:
    """Rows in the query's state after each micro-batch, from its progress reports."""
    return [sum(op.get("numRowsTotal", 0) for op in p.get("stateOperators") or []) for p in query.recentProgress or []]


def read_snapshot(spark: SparkSession, path: str, query=None) -> DataFrame:
    """The newest complete result written by ``start_snapshot_query``.

    The batch id comes from the query's last progress; without one, the newest
    ``batch_id`` folder is chosen by a scalar subquery over the partition column.
    """
    progress = query.lastProgress if query is not None else None
    if progress and progress.get("batchId") is not None:
        bid = int(progress["batchId"])
        return spark.read.parquet(os.path.join(path, f"batch_id={bid}"))
    table = spark.read.parquet(path)
    newest = table.select(F.max("batch_id")).scalar()
    return table.filter(F.col("batch_id") == newest).drop("batch_id")


def batch_latency(query) -> dict:
    """Per-micro-batch processing time of a finished or running query, from its
    progress reports (metadata only): batches with input, and the median and
    largest ``triggerExecution`` time in milliseconds. (Row counts are left out:
    a foreachBatch sink that runs more than one action per batch makes the
    reported input rows count some rows twice.)"""
    runs = [(p.get("numInputRows") or 0, (p.get("durationMs") or {}).get("triggerExecution"))
            for p in (query.recentProgress or [])]
    ms = sorted(t for n, t in runs if n and t is not None)
    if not ms:
        return {"batches": 0, "median_ms": None, "max_ms": None}
    return {"batches": len(ms), "median_ms": ms[len(ms) // 2], "max_ms": ms[-1]}


def offsets_total(progress: dict | None) -> dict[str, int]:
    """T2s: end offsets of a query's last progress, summed per source that counts messages (Kafka: {topic: {partition:
    offset}}). Other sources' offsets are no message counts and are left out."""
    out: dict[str, int] = {}
    for src in (progress or {}).get("sources", []):
        end = src.get("endOffset")
        if isinstance(end, str):
            try:
                end = json.loads(end)
            except ValueError:
                end = None
        if isinstance(end, dict) and end and all(isinstance(parts, dict) for parts in end.values()):
            out[src.get("description", "source")] = sum(int(v) for parts in end.values() for v in parts.values())
    return out


def progress_snapshot(spark: SparkSession, query, topic: str,
                      run_time: _dt.datetime | None = None) -> DataFrame:
    """T2s: one snapshot row (run_time, topic, total) from a running query's progress: end offsets where the source
    counts messages, else the rows read in the progress reports that the query still holds
    (``streaming.progress`` keeps them all)."""
    totals = offsets_total(query.lastProgress)
    total = sum(totals.values()) if totals else sum(p.get("numInputRows") or 0 for p in query.recentProgress or [])
    run_time = run_time or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(run_time, topic, total)], OFFSET_SNAPSHOT)
