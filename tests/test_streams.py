"""Rejected messages, repeated messages, chained windows and the progress listener."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from revlens.operators import quality
from revlens.sources import messages
from revlens.streaming import monitors, progress, scoring

START = dt.datetime(2024, 5, 1)
GOOD = '{"Id":1,"ProductId":"p","Summary":"s","Text":"t","cleaned":"fine"}'


class Fixed:
    """A model with one answer: the tests look at what is scored, not at how."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        return df.withColumns({"prediction": F.lit(2.0), "probability": array_to_vector(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)))})


@pytest.mark.parametrize("value,reason", [
    (GOOD, None), ('{"Id":2}', None), ('{"Id":3,"other":[1]}', None), (' {"Id": 4} ', None), ('{"Id":null,"Text":"t"}', "no id"),
    ("{}", "no id"), ("null", "wrong type"), (None, "no value"), ("", "no value"), ("  ", "no value"), ("not json", "not json"),
    (GOOD[:-1], "not json"), (GOOD + "x", "not json"), (GOOD + GOOD, "not json"), (GOOD + "," + GOOD, "not json"),
    (GOOD + '],[{}', "not json"), ('{"Id":1,"Id":2}', None), ('{"Id":1,"Text":"a]b,\\"c"}', None), ('{"Id":"x1"}', "wrong type"), ('{"Id":1,"Time":"noon"}', "wrong type"),
    ("[1, 2]", "wrong type"), ("5", "wrong type"), ('{"Id":1.5}', "wrong type")])
def test_reason_of_a_message(spark, value, reason):
    for kind in ("string", "binary"):
        raw = spark.createDataFrame([("k", value)], "key string, value string").withColumn("value", F.col("value").cast(kind))
        row = messages.decode(raw).first()
        assert row.reason == reason and row.value == value
        assert messages.decode_reviews(raw).count() == (reason is None)
        assert messages.rejected(messages.decode(raw)).count() == (reason is not None)


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").json(folder)


def test_rejected_messages_are_stored_once_and_never_scored(spark, scratch):
    inbox, table, live, bad = (os.path.join(scratch, n) for n in ("in", "p", "l", "bad"))
    batches = [[("a", GOOD), ("b", "no"), ("c", None)], [("a", "{}")], [("d", GOOD.replace("1", "7", 1))]]

    def run():
        raw = messages.message_files_source(spark, inbox, max_files_per_trigger=1)
        scoring.start_single_pass(raw, Fixed(), table, live, os.path.join(scratch, "c"), available_now=True, rejected_path=bad).awaitTermination()
        scoring.start_rejected_query(raw, bad + "2", os.path.join(scratch, "c2"), available_now=True).awaitTermination()

    write_batches(spark, inbox, batches[:2])
    run()
    write_batches(spark, inbox, batches[2:])
    run()  # goes on from the checkpoint
    assert sorted(r.Id for r in spark.read.parquet(table).collect()) == [1, 7]
    assert spark.read.schema("key string, value string").json(live).count() == 2
    for path in (bad, bad + "2"):
        got = spark.read.parquet(path)
        assert sorted((r.reason, r.key, r.value) for r in got.select("reason", "key", F.coalesce("value", F.lit("-")).alias("value")).collect()) == [
            ("no id", "a", "{}"), ("no value", "c", "-"), ("not json", "b", "no")]
    again = spark.createDataFrame([("x", "k", "v")], "reason string, key string, value string")
    scoring.write_rejected_batch(again, 0, bad, scoring.run_name(spark, os.path.join(scratch, "c")))  # a replay of batch 0
    assert spark.read.parquet(bad).count() == 3


def event_stream(spark, folder, batches):
    for rows in batches:
        frame = spark.createDataFrame([(i, START + dt.timedelta(minutes=m)) for i, m in rows], "Id long, ts timestamp")
        frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("Id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_repeats_within_the_delay_are_dropped_and_the_state_stays_flat(spark, scratch):
    # Each batch: ten new ids, three of the last batch's again, one twice in the batch itself, a NULL id.
    batches = [[(10 * b + i, 10 * b + i) for i in range(10)] + [(10 * (b - 1) + i, 10 * b) for i in range(3) if b] + [(10 * b, 10 * b + 5)]
               for b in range(12)]
    batches.append([(0, 130)])   # a repeat after the delay is a new message
    stream = event_stream(spark, os.path.join(scratch, "in"), batches)
    q = monitors.start_append_query(scoring.once_per_message(stream, "ts", "30 minutes"), os.path.join(scratch, "out"),
                                    os.path.join(scratch, "c"), available_now=True)
    q.awaitTermination()
    got = sorted(r.Id for r in monitors.read_closed(spark, os.path.join(scratch, "out")).collect())
    assert got == sorted([*range(120), 0])
    rows = monitors.state_rows(q)
    # A key goes when the watermark (30 minutes behind) has passed its time by the delay (30 minutes): an hour's ids and a batch.
    assert len(rows) > 10 and max(rows) <= 70 and rows[8:12] == [70] * 4


def test_closed_windows_equal_sliding_windows_and_count_each_event_once(spark, scratch):
    batches = [[(i, b * 7 + i * 0.11) for i in range(40)] for b in range(5)] + [[(0, 300)], [(1, 301)]]
    stream = event_stream(spark, os.path.join(scratch, "in"), batches)
    out = os.path.join(scratch, "out")
    result = monitors.closed_throughput(stream, "ts", "60 seconds", "10 seconds", "2 minutes")
    q = monitors.start_append_query(result, out, os.path.join(scratch, "c"), available_now=True)
    q.awaitTermination()
    batch = spark.read.parquet(os.path.join(scratch, "in"))
    want = batch.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
    closed = want.filter(F.col("end") <= F.lit(START + dt.timedelta(minutes=299)))
    got = monitors.read_closed(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))
    # The first operator of the state updates a bucket per event, not a window for each of six.
    updated = [sum(op["numRowsUpdated"] for op in p["stateOperators"][-1:]) for p in q.recentProgress if p["numInputRows"] == 40]
    assert updated and max(updated) <= 40


def test_progress_listener_counts_messages_and_goes_on_after_a_restart(spark, scratch):
    inbox, table = os.path.join(scratch, "in"), os.path.join(scratch, "progress")

    def run(name):
        log = progress.ProgressLog(spark, table, {name: "topic"})
        spark.streams.addListener(log)
        try:
            q = (messages.message_files_source(spark, inbox, max_files_per_trigger=1).writeStream.queryName(name).format("parquet")
                 .option("path", os.path.join(scratch, "out")).option("checkpointLocation", os.path.join(scratch, "c"))
                 .trigger(processingTime="100 milliseconds").start())
            q.processAllAvailable()
            assert progress.wait_for(lambda: log.reports.get("topic", 0) >= 2)
            q.stop()
        finally:
            spark.streams.removeListener(log)

    write_batches(spark, inbox, [[("k", GOOD)] * 5, [("k", "x")] * 2])
    run("progress_first")
    write_batches(spark, inbox, [[("k", GOOD)] * 4])
    run("progress_second")
    rows = quality.traffic(progress.snapshots(spark, table)).orderBy("run_time").collect()
    grown = [r.value for r in rows if r.status == "ok"]
    assert grown == [0.0, 2.0, 4.0] and any(r.status == "fail" for r in rows)
    assert max(r.total for r in progress.snapshots(spark, table).collect()) == 11


def test_offsets_of_a_source_that_counts_no_messages_are_left_out():
    kafka = {"sources": [{"description": "K", "endOffset": {"t": {"0": 5, "1": 7}}}, {"description": "F", "endOffset": {"logOffset": 9}}]}
    assert monitors.offsets_total(kafka) == {"K": 12}
    assert monitors.offsets_total({"sources": [{"description": "K", "endOffset": json.dumps({"t": {"0": 3}})}]}) == {"K": 3}
    assert monitors.offsets_total({"sources": [{"endOffset": '{"logOffset":9}'}, {"endOffset": None}, {"endOffset": "odd"}]}) == {}
    assert monitors.offsets_total(None) == {}


def test_a_message_is_made_and_parsed_once(spark):
    """A filter on the reason, pushed below the parsing, made every message anew for each field that it asks."""
    rows = spark.createDataFrame([(1, "p", "u", 5, "s", "t", "c", 2), (None, "p", "u", 5, "s", "t", "c", 2)],
                                 "Id long, ProductId string, UserId string, Time long, Summary string, Text string, cleaned string, sentiment int")
    made = rows.withColumn("cleaned", F.regexp_replace("cleaned", "[^a-z]", " "))
    reviews = messages.accepted(messages.decode(messages.publish_reviews(made)))
    plan = reviews._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("StructsToJsonEvaluator", "from_json(", "regexp_replace(")] == [1, 1, 1]
    assert [(r.Id, r.cleaned, r.true_sentiment) for r in reviews.collect()] == [(1, "c", 2)]
