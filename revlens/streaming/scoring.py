"""Stream scoring (E2): decode -> clean -> score -> live sink + stats table (S4, S6, S7, P4, P22, T1s).

Two ways to run it:

* ``start_two_queries`` mirrors the reference: a 1 s live query and a 10 s
  stats query, each with its own checkpoint (each re-reads the source and
  scores it).
* ``start_single_pass`` scores each micro-batch once and writes both
  outputs from one ``foreachBatch``.

The stats sink writes each micro-batch to ``<table>/run=<run>/batch_id=<id>``.
The run is a name kept in the query's checkpoint: a restart goes on with it,
while a fresh checkpoint (whose batch ids start at 0 again) or a second
query gets its own folder and never replaces stored rows. A batch that is already
committed is skipped when replayed, so neither the table nor a stream
that tails it sees a row twice (T8). Everything runs on the executors; no
batch is pulled to the driver.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import fill_cleaned
from revlens.plans.scoring import prediction_record, score
from revlens.sources.messages import accepted, decode, decode_reviews, live_records, rejected

LIVE_TRIGGER = "1 second"
STATS_TRIGGER = "10 seconds"


def prepare(parsed: DataFrame) -> DataFrame:
    """Clean only messages that arrive without a cleaned text."""
    return parsed.withColumn("cleaned", fill_cleaned("cleaned", "Summary", "Text"))


def scored_stream(raw: DataFrame, model) -> DataFrame:
    """S4 + P4 + M6 + P5 + P6 + P7 on a stream (or a batch) of raw messages; what is no review is not scored."""
    return prediction_record(score(model, prepare(decode_reviews(raw))))


def stamp(batch: DataFrame) -> DataFrame:
    """One ingest time per micro-batch (current_timestamp is fixed per query run)."""
    return batch.withColumn("inserted_at", F.current_timestamp())


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the query that owns this checkpoint: an empty file ``run-<name>`` beside its metadata."""
    fs, folder = _fs_path(spark, os.path.join(checkpoint, "sink"))
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("run-"):
                return name[len("run-"):]
    name = uuid.uuid4().hex
    fs, path = _fs_path(spark, os.path.join(checkpoint, "sink", f"run-{name}"))
    fs.create(path).close()
    return name


def batch_path(table_path: str, run: str, batch_id: int) -> str:
    return os.path.join(table_path, f"run={run}", f"batch_id={batch_id}")


def committed(spark: SparkSession, path: str) -> bool:
    fs, mark = _fs_path(spark, os.path.join(path, "_SUCCESS"))
    return bool(fs.exists(mark))


def write_stats_batch(batch: DataFrame, batch_id: int, table_path: str, run: str = "0") -> int:
    """S7 + A26: skip an empty or already committed batch; otherwise write it as
    partition run=<run>/batch_id=<id> and return the rows written, counted by an
    observed metric during the write (no second pass over the batch)."""
    path = batch_path(table_path, run, batch_id)
    if committed(batch.sparkSession, path):
        return 0
    batch = batch.persist()  # scored once for the emptiness test and the write
    try:
        if batch.isEmpty():
            return 0
        obs = Observation(f"stats_batch_{batch_id}_{uuid.uuid4().hex}")
        stamp(batch).observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        return int(obs.get["rows"])
    finally:
        batch.unpersist()


def start_stats_query(scored: DataFrame, table_path: str, checkpoint: str,
                      trigger: str = STATS_TRIGGER, available_now: bool = False):
    """S7 as its own streaming query."""
    run = run_name(scored.sparkSession, checkpoint)
    w = (scored.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: write_stats_batch(b, i, table_path, run)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def start_live_query(scored: DataFrame, checkpoint: str, live_path: str | None = None,
                     kafka_servers: str | None = None, topic: str = "predictions-live",
                     trigger: str = LIVE_TRIGGER, available_now: bool = False):
    """Keyed compact JSON to Kafka, or to a JSON-lines folder when no broker is given."""
    live = live_records(scored)
    w = live.writeStream.option("checkpointLocation", checkpoint)
    if kafka_servers:
        w = w.format("kafka").option("kafka.bootstrap.servers", kafka_servers).option("topic", topic)
    else:
        w = w.format("json").option("path", live_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def start_two_queries(raw: DataFrame, model, table_path: str, checkpoint_root: str,
                      live_path: str | None = None, kafka_servers: str | None = None,
                      available_now: bool = False):
    """T1s: the live and stats paths as two queries with separate checkpoints."""
    scored = scored_stream(raw, model)
    q_live = start_live_query(scored, os.path.join(checkpoint_root, "live"), live_path, kafka_servers,
                              available_now=available_now)
    q_stats = start_stats_query(scored, table_path, os.path.join(checkpoint_root, "stats"),
                                available_now=available_now)
    return q_live, q_stats


def write_both_batch(batch: DataFrame, batch_id: int, table_path: str, live_path: str, run: str = "0") -> None:
    """One micro-batch: score once (persisted), write the stats partition and the live records (each unless committed)."""
    stored, live = batch_path(table_path, run, batch_id), batch_path(live_path, run, batch_id)
    stamped = stamp(batch).persist()
    try:
        if stamped.isEmpty():
            return
        if not committed(batch.sparkSession, stored):
            stamped.write.mode("overwrite").parquet(stored)
        if not committed(batch.sparkSession, live):
            live_records(stamped).write.mode("overwrite").json(live)
    finally:
        stamped.unpersist()


def write_rejected_batch(messages: DataFrame, batch_id: int, path: str, run: str = "0") -> None:
    """One micro-batch of rejected messages -> ``path/run=<run>/batch_id=<id>``; nothing for a batch without any or stored already."""
    target = batch_path(path, run, batch_id)
    if not committed(messages.sparkSession, target) and not messages.isEmpty():
        messages.write.mode("overwrite").parquet(target)


def start_rejected_query(raw: DataFrame, path: str, checkpoint: str, trigger: str = STATS_TRIGGER, available_now: bool = False):
    """The rejected messages of a stream as a query of their own, beside the two of ``start_two_queries``."""
    run = run_name(raw.sparkSession, checkpoint)
    w = (rejected(decode(raw)).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: write_rejected_batch(b, i, path, run)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def write_message_batch(batch: DataFrame, batch_id: int, model, table_path: str, live_path: str, rejected_path: str,
                        run: str = "0") -> None:
    """One micro-batch of raw messages: decoded once (persisted), reviews scored into both outputs, the others into the rejected table."""
    decoded = decode(batch).persist()
    try:
        write_both_batch(prediction_record(score(model, prepare(accepted(decoded)))), batch_id, table_path, live_path, run)
        write_rejected_batch(rejected(decoded), batch_id, rejected_path, run)
    finally:
        decoded.unpersist()


def start_single_pass(raw: DataFrame, model, table_path: str, live_path: str, checkpoint: str,
                      trigger: str = LIVE_TRIGGER, available_now: bool = False, rejected_path: str | None = None):
    """T1s alternative: one query, each batch decoded and scored once, every output idempotent per batch."""
    run = run_name(raw.sparkSession, checkpoint)
    if rejected_path is None:
        w = (scored_stream(raw, model).writeStream.option("checkpointLocation", checkpoint)
             .foreachBatch(lambda b, i: write_both_batch(b, i, table_path, live_path, run)))
    else:
        w = (raw.writeStream.option("checkpointLocation", checkpoint)
             .foreachBatch(lambda b, i: write_message_batch(b, i, model, table_path, live_path, rejected_path, run)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()


def once_per_message(stream: DataFrame, event_time: str, delay: str, keys: tuple[str, ...] = ("Id",)) -> DataFrame:
    """Messages that are delivered again are dropped (T1s, T3s): the first of each key within ``delay`` of event time stays.

    The state holds the keys of the last ``delay`` only; a repeat that comes later than that is a new message.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def read_stats_table(spark: SparkSession, table_path: str) -> DataFrame:
    """S9 over the stats sink output (run and batch_id are partition columns)."""
    return spark.read.parquet(table_path)
