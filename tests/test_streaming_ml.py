"""Stream scoring on a file source with checkpoints; model persistence; batch == stream."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from revlens.operators import prep
from revlens.plans import scoring, training
from revlens.sources import messages, tables
from revlens.streaming import monitors
from revlens.streaming import scoring as sscore


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    d = SF_SMALL
    split_df = prep.stratified_split(prep.clean_reviews(tables.reviews(spark, d))).cache()
    balanced, _, test = training.training_tables(split_df)
    model = training.fit_logreg(balanced, maxIter=5)
    path = str(tmp_path_factory.mktemp("model") / "best_model")
    training.save_model(model, path)
    return training.load_model(path), split_df


def _publish(spark, split_df, folder, part):
    msgs = messages.publish_reviews(split_df.filter(F.col("split") == part)
                                    .withColumn("cleaned", F.when(F.col("Id") % 3 == 0, F.col("cleaned"))))
    messages.write_message_files(msgs, folder)


def test_stream_scores_equal_batch_scores_and_restart(spark, trained, scratch):
    model, split_df = trained
    inbox = os.path.join(scratch, "inbox")
    table = os.path.join(scratch, "predictions")
    live = os.path.join(scratch, "live")
    ckpt = os.path.join(scratch, "ckpt")
    _publish(spark, split_df, os.path.join(inbox, "a"), "test")

    raw = messages.message_files_source(spark, inbox + "/*")
    q_live, q_stats = sscore.start_two_queries(raw, model, table, ckpt, live_path=live, available_now=True)
    q_live.awaitTermination(120)
    q_stats.awaitTermination(120)

    stored = sscore.read_stats_table(spark, table)
    n_test = split_df.filter("split = 'test'").count()
    assert stored.count() == n_test
    assert stored.filter(F.col("inserted_at").isNull()).count() == 0
    # batch scoring of the same rows gives the same predictions
    batch = scoring.score(model, split_df.filter("split = 'test'")).select("Id", F.col("prediction").alias("b"))
    joined = stored.join(batch, "Id")
    assert joined.count() == n_test and joined.filter(F.col("prediction") != F.col("b")).count() == 0

    # restart from the checkpoints with new files: only the new rows arrive
    _publish(spark, split_df, os.path.join(inbox, "b"), "val")
    q_live, q_stats = sscore.start_two_queries(raw, model, table, ckpt, live_path=live, available_now=True)
    q_live.awaitTermination(120)
    q_stats.awaitTermination(120)
    n_val = split_df.filter("split = 'val'").count()
    stored = sscore.read_stats_table(spark, table)
    assert stored.count() == n_test + n_val
    assert stored.groupBy("Id").count().filter("count > 1").count() == 0

    live_rows = messages.normalise_live(spark.read.json(live)).collect()
    assert len(live_rows) == n_test + n_val
    assert all(len(r.summary) <= 120 and r.sentiment in ("negative", "neutral", "positive") for r in live_rows)


def test_replayed_batch_is_idempotent(spark, trained, scratch):
    model, split_df = trained
    batch = scoring.prediction_record(scoring.score(model, split_df.filter("split = 'val'")
                                                    .withColumnRenamed("sentiment", "true_sentiment")))
    table = os.path.join(scratch, "t")
    n = batch.count()
    assert sscore.write_stats_batch(batch, 7, table) == n
    assert sscore.write_stats_batch(batch, 7, table) == 0          # replay of batch 7: committed, skipped
    assert sscore.write_stats_batch(batch.limit(1), 7, table, run="other") == 1  # another run's batch 7 replaces nothing
    names = {sscore.run_name(spark, os.path.join(scratch, "ckpt")) for _ in range(2)}
    assert len(names) == 1 and sscore.run_name(spark, os.path.join(scratch, "fresh")) not in names
    assert sscore.write_stats_batch(batch.limit(0), 8, table) == 0  # empty batch skipped
    assert spark.read.parquet(table).count() == batch.count() + 1


def test_single_pass_and_monitors(spark, trained, scratch):
    model, split_df = trained
    inbox = os.path.join(scratch, "inbox")
    _publish(spark, split_df, inbox, "val")
    raw = messages.message_files_source(spark, inbox)
    q = sscore.start_single_pass(raw, model, os.path.join(scratch, "p"), os.path.join(scratch, "l"),
                                 os.path.join(scratch, "c"), available_now=True)
    q.awaitTermination(120)
    n_val = split_df.filter("split = 'val'").count()
    assert spark.read.parquet(os.path.join(scratch, "p")).count() == n_val
    assert spark.read.json(os.path.join(scratch, "l")).count() == n_val

    scored = sscore.scored_stream(messages.message_files_source(spark, inbox), model)
    qc = monitors.start_counters(scored, os.path.join(scratch, "cc"), "counters_t", available_now=True)
    qc.awaitTermination(120)
    assert sum(r["count"] for r in spark.table("counters_t").collect()) == n_val

    tail = monitors.tail_predictions(spark, os.path.join(scratch, "p"))
    thr = monitors.throughput_stream(tail)
    qt = (thr.writeStream.outputMode("update").format("memory").queryName("thr_t")
          .option("checkpointLocation", os.path.join(scratch, "tc")).trigger(availableNow=True).start())
    qt.awaitTermination(120)
    assert spark.table("thr_t").agg(F.max("n")).first()[0] == n_val


def test_metadata_roundtrip(spark, scratch):
    import json
    p = os.path.join(scratch, "meta.json")
    with open(p, "w") as f:
        json.dump([{"name": "m1", "f1_score": 0.9}, {"model_type": "NaiveBayes"}], f)
    from revlens.sources import files
    rows = files.load_metadata(spark, p).orderBy("name").collect()
    assert [(r.name, r.model_type, r.f1_score, r.accuracy, r.is_active) for r in rows] == [
        ("LogReg-TFIDF", "NaiveBayes", 0.8274, 0.85, True), ("m1", "LogisticRegression", 0.9, 0.85, True)]


def test_kafka_connector_missing_is_reported(spark):
    with pytest.raises(Exception) as e:
        messages.kafka_source(spark, "localhost:1", "t")
    assert "kafka" in str(e.value).lower()


def test_progress_snapshot_and_export(spark, trained, scratch):
    model, split_df = trained
    inbox = os.path.join(scratch, "in")
    _publish(spark, split_df, inbox, "val")
    raw = messages.message_files_source(spark, inbox)
    q = (messages.decode_reviews(raw).writeStream.format("memory").queryName("snap_t")
         .option("checkpointLocation", os.path.join(scratch, "c")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    snap = monitors.progress_snapshot(spark, q, "reviews").first()
    assert snap.topic == "reviews" and snap.total >= 0
    out = os.path.join(scratch, "export")
    scoring.export_test_predictions(scoring.score(model, split_df.filter("split = 'test'")), out)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert back.columns == scoring.EXPORT_COLUMNS
    assert back.count() == split_df.filter("split = 'test'").count()


def test_cross_validation_small(spark, trained):
    _, split_df = trained
    balanced, val, _ = training.training_tables(split_df)
    cv = training.cross_validate(balanced, folds=2, reg_params=[0.1], max_iters=[5])
    assert len(cv.avgMetrics) == 1 and cv.best == {"regParam": 0.1, "maxIter": 5}
    best = training.pipeline_of(cv)
    assert "probability" in best.transform(val).columns
    name, _, f1 = training.select_best({"LogisticRegression": (cv, 0.5), "NaiveBayes": (None, 0.5)})
    assert name == "LogisticRegression" and f1 == 0.5


def test_stats_record_shape(spark, scratch):
    from revlens.operators import profile
    from revlens.sources import files
    split_df = prep.stratified_split(prep.clean_reviews(tables.reviews(spark, SF_SMALL)))
    rec = profile.stats_record(profile.preprocessing_stats(split_df))
    files.write_json_record(rec, os.path.join(scratch, "stats"))
    back = spark.read.json(os.path.join(scratch, "stats")).first()
    assert back.total == back.train + back.val + back.test
    assert back.classes.negative + back.classes.neutral + back.classes.positive == back.total


def test_evaluate_equals_mllib_evaluator(spark, trained):
    model, split_df = trained
    val = prep.drop_unusable(split_df.filter("split = 'val'"))
    ours = training.evaluate(model, val)
    preds = model.transform(val)
    for name in ("f1", "accuracy", "weightedPrecision", "weightedRecall"):
        assert abs(training.evaluator(name).evaluate(preds) - ours[name]) < 1e-9


def test_label_counters_survive_restart(spark, scratch):
    """T4s: state restored from the checkpoint keeps counting across restarts."""
    from revlens.schemas import PREDICTION
    inbox, ckpt = os.path.join(scratch, "in"), os.path.join(scratch, "ck")
    rows = [(i, None, None, None, None, None, None, None, 1.0, "neutral" if i % 3 else "negative", 0.9, None)
            for i in range(30)]
    df = spark.createDataFrame(rows, PREDICTION)
    df.filter("Id < 15").write.mode("append").parquet(os.path.join(inbox, "a"))

    def run():
        stream = spark.readStream.schema(PREDICTION).parquet(inbox + "/*")
        q = monitors.start_counters(stream, ckpt, "restart_t", available_now=True)
        q.awaitTermination(120)
        return {r.label: r["count"] for r in spark.table("restart_t").collect()}

    assert run() == {"neutral": 10, "negative": 5}
    df.filter("Id >= 15").write.mode("append").parquet(os.path.join(inbox, "b"))
    assert run() == {"neutral": 20, "negative": 10}


def test_snapshot_sink_survives_restart_and_keeps_all_windows(spark, scratch):
    """Complete-mode results go to versioned parquet folders written by the
    executors; a restart resumes from the checkpoint and the newest folder
    holds the whole result (every window, not a driver-side copy)."""
    from revlens.schemas import PREDICTION
    import datetime as dt
    inbox, ckpt, out = (os.path.join(scratch, x) for x in ("in", "ck", "out"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, None, None, None, None, None, None, None, 1.0, "positive", 0.9, t0 + dt.timedelta(seconds=7 * i))
            for i in range(200)]
    df = spark.createDataFrame(rows, PREDICTION)
    df.filter("Id < 100").write.mode("append").parquet(os.path.join(inbox, "a"))

    def run():
        stream = spark.readStream.schema(PREDICTION).parquet(inbox + "/*")
        q = monitors.start_snapshot_query(monitors.throughput_stream(stream), out, ckpt, available_now=True)
        q.awaitTermination(120)
        return monitors.read_snapshot(spark, out, q)

    def windows(frame):
        return {(r.window_start, r.n) for r in frame.collect()}

    assert windows(run()) == windows(monitors.throughput_stream(df.filter("Id < 100")))
    df.filter("Id >= 100").write.mode("append").parquet(os.path.join(inbox, "b"))
    second = run()
    expected = windows(monitors.throughput_stream(df))
    assert windows(second) == expected
    # Without the query handle the newest batch folder is found from the partition column.
    assert windows(monitors.read_snapshot(spark, out)) == expected


def test_compact_predictions_keeps_rows_and_prunes(spark, scratch):
    from revlens.operators import products
    src, dst = os.path.join(scratch, "raw"), os.path.join(scratch, "compact")
    keyed = tables.predictions_keyed(spark, SF_SMALL)
    keyed.write.parquet(os.path.join(src, "batch_id=0"))
    out = tables.compact_predictions(spark, src, dst, files_per_day=2)
    assert out.count() == keyed.count()
    q = products.product_summary(out, "42")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ProductId,42)" in plan
    assert q.first().totalReviews == keyed.filter("ProductId = '42'").count()


def test_batch_latency_from_progress():
    class Q:
        recentProgress = [{"numInputRows": 5, "durationMs": {"triggerExecution": 300}},
                          {"numInputRows": 0, "durationMs": {"triggerExecution": 5}},
                          {"numInputRows": 7, "durationMs": {"triggerExecution": 100}},
                          {"numInputRows": 2, "durationMs": {"triggerExecution": 200}}]
    assert monitors.batch_latency(Q()) == {"batches": 3, "median_ms": 200, "max_ms": 300}

    class Empty:
        recentProgress = []
    assert monitors.batch_latency(Empty())["batches"] == 0


def test_monthly_trend_year_range_reaches_the_scan(spark, scratch):
    """On a stored prediction table the year range (seconds or milliseconds) is a
    pushed Parquet filter on Time, so row groups of other years are skipped."""
    from revlens.operators import trends
    path = os.path.join(scratch, "pred")
    tables.predictions_keyed(spark, SF_SMALL).write.parquet(path)
    q = trends.monthly_trend(spark.read.parquet(path), 2011)
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    # (Spark abbreviates long filter lists in the plan text, so only the seconds half is matched.)
    assert any("Or(And(GreaterThanOrEqual(Time,1293840000),LessThan(Time,1325376000))" in p for p in pushed)


def test_recent_rows_cutoff_reaches_the_scan(spark, scratch):
    """On a stored table the newest-rows cutoff is a literal range on inserted_at,
    pushed into the Parquet scan, and the time-only first step reads one column."""
    from revlens.operators import feed
    path = os.path.join(scratch, "pred")
    tables.predictions_keyed(spark, SF_SMALL).write.parquet(path)
    q = feed.recent(spark.read.parquet(path), 50)
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert any("GreaterThanOrEqual(inserted_at," in line for line in plan.splitlines() if "PushedFilters" in line)


def test_cross_validation_equals_a_fit_per_fold(spark, trained):
    """Features are fitted once per fold: the mean F1 equals whole pipelines fitted on each fold's training rows."""
    _, split_df = trained
    balanced, _, _ = training.training_tables(split_df)
    cv = training.cross_validate(balanced, folds=2, reg_params=[0.01, 0.1], max_iters=[5])
    data = training.with_folds(balanced, 2)
    want = []
    for reg in (0.01, 0.1):
        scores = [training.evaluate(training.fit_logreg(data.filter(f"fold <> {k}"), regParam=reg, maxIter=5),
                                    data.filter(f"fold = {k}"))["f1"] for k in range(2)]
        want.append(sum(scores) / 2)
    assert cv.avgMetrics == pytest.approx(want, abs=1e-6)
    assert cv.params[cv.avgMetrics.index(max(cv.avgMetrics))] == cv.best


def test_throughput_append_keeps_state_flat_and_equals_the_batch(spark, scratch):
    """Closed windows are stored once and equal the batch counts; the state holds the open windows only."""
    import datetime as dt
    from revlens.plans import catalog
    rows = tables.predictions_keyed(spark, SF_SMALL).withColumn(
        "inserted_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, Id * 7)"))
    stream = catalog._as_file_stream(spark, rows, "flat")
    out = os.path.join(scratch, "out")
    q = monitors.start_append_query(monitors.throughput_stream(stream), out, os.path.join(scratch, "ck"), available_now=True)
    q.awaitTermination(120)
    last = rows.agg(F.max("inserted_at")).first()[0] - dt.timedelta(minutes=2)
    want = {(r.window_start, r.n) for r in monitors.throughput_stream(rows).collect() if r.window_end <= last}
    got = [(r.window_start, r.n) for r in monitors.read_closed(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert max(monitors.state_rows(q)[1:]) < 40 + len(want) / 2 and monitors.state_rows(q)[-1] < 40


def test_append_query_skips_a_committed_batch(spark, scratch):
    one = spark.range(3).toDF("Id")
    for _ in range(2):
        monitors.write_closed_batch(one, 0, os.path.join(scratch, "t"), "r")
    monitors.write_closed_batch(one, 0, os.path.join(scratch, "t"), "s")
    assert sorted(r.Id for r in monitors.read_closed(spark, os.path.join(scratch, "t")).collect()) == [0, 0, 1, 1, 2, 2]


def test_classifiers_fitted_on_term_counts_equal_those_fitted_on_texts(spark, monkeypatch):
    """Texts are counted once and written; folds, refits and both classifiers read the counts."""
    texts = ["good tea strong leaf", "bad stale tea", "fine tea box", "good leaf", "stale bad box", "fine box fine"]
    rows = [(i, f"{texts[i % 6]} word{i % 4}", (2, 0, 1)[i % 3], 1.0) for i in range(60)]
    frame = spark.createDataFrame(rows, "Id long, cleaned string, sentiment int, classWeight double")
    counts = training.term_counts(frame)
    assert "cleaned" not in counts.columns and training.term_counts(counts) is counts and len(counts.inputFiles()) > 0
    for fit in (training.fit_naive_bayes, training.fit_logreg):
        got, want = (sorted((r.Id, r.prediction) for r in fit(x).transform(frame).select("Id", "prediction").collect()) for x in (counts, frame))
        assert got == want
    assert training.fits_at_a_time(counts, 6) == 6
    monkeypatch.setattr(training, "KEPT_BYTES", 1)
    assert training.fits_at_a_time(counts, 6) == 1
