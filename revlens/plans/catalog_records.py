"""Registered queries, second part: record shapes, stored files, the stream sinks and fitted models.

Importing the module adds them to ``catalog.REGISTRY``. Queries around a fitted
model return what is exact about it, so that each has an oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.functions.text import clean_text, clean_text_sql, full_text
from revlens.functions.timefn import MAX_TIME, MIN_TIME, valid_time
from revlens.operators import distribution, evaluation, feed, lemmas, prep, profile
from revlens.plans import catalog as C
from revlens.sources import files, messages
from revlens.sources import tables as T

V, register = T.with_views, C.register
LABELS_WANTED = ["negative", "positive"]
FORM_LENGTH, LEMMA_LENGTH = 7, 6


# ---------------------------------------------------------------- records
@register("display_ids", V("""
select case when Id % 3 = 0 then 'k' || Id else cast(Id as varchar) end as id, sentiment_label as sentiment
from predictions_keyed""", "predictions_keyed"))
def q_display_ids(spark, d):
    """A record without ``Id`` shows the store's ``_id``."""
    rows = (C._pk(spark, d).withColumn("_id", F.concat(F.lit("k"), F.col("Id").cast("string")))
            .withColumn("Id", F.when(F.col("Id") % 3 != 0, F.col("Id"))))
    return feed.format_prediction(rows).select("id", "sentiment")


@register("serialised_rows", V("""
select cast(Id as varchar) as Id, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S.%f') as inserted_at, prediction
from predictions_keyed""", "predictions_keyed"))
def q_serialised_rows(spark, d):
    """P20: JSON-safe values."""
    return feed.serialise(C._pk(spark, d).select("Id", "inserted_at", "prediction"))


@register("rows_of_labels", V("""
select Id, sentiment_label from predictions_keyed where sentiment_label in ('negative', 'positive')""", "predictions_keyed"))
def q_rows_of_labels(spark, d):
    """P19."""
    return feed.by_sentiments(C._pk(spark, d), LABELS_WANTED).select("Id", "sentiment_label")


@register("rows_of_product", V(f"""
select Id, confidence from predictions_keyed where ProductId = '{C.KEYED_PRODUCT}'""", "predictions_keyed"))
def q_rows_of_product(spark, d):
    """P14."""
    return feed.by_product(C._pk(spark, d), C.KEYED_PRODUCT).select("Id", "confidence")


@register("rows_in_valid_time", V(f"""
select sentiment_label, count(*) as n from predictions_big where Time between {MIN_TIME} and {MAX_TIME} group by 1""",
                                  "predictions_big"))
def q_rows_in_valid_time(spark, d):
    """The range filter reaches the scan."""
    return C._pb(spark, d).filter(valid_time()).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))


@register("cast_labels", V("""
select Id, case when Id % 7 = 0 or Id % 5 = 0 then -1 else sentiment end as sentiment from reviews""", "reviews"))
def q_cast_labels(spark, d):
    """Labels that came as text; what is no number becomes NULL (shown as -1)."""
    text = (F.when(F.col("Id") % 7 == 0, F.lit("n/a")).when(F.col("Id") % 5 == 0, F.lit(None))
            .otherwise(F.col("sentiment").cast("string")))
    cast = prep.cast_label(T.labelled_reviews(spark, d).select("Id", text.alias("sentiment")))
    return cast.select("Id", F.coalesce("sentiment", F.lit(-1)).alias("sentiment"))


_TRAIN_CTES = {"cleaned": C._CLEANED_SQL, "splits": C._SPLIT_SQL, "train": "select * from splits where split = 'train'",
               "balanced": C._BALANCED_SQL + " and cleaned is not null and cleaned <> ''"}


@register("weighted_training_rows", V("""
select Id, sentiment, cast(count(*) over () as double) / (3.0 * count(*) over (partition by sentiment)) as classWeight
from balanced""", "reviews", ctes=_TRAIN_CTES))
def q_weighted_training_rows(spark, d):
    """The training rows with their class weight."""
    return prep.with_class_weight(C._balanced(spark, d)).select("Id", "sentiment", "classWeight")


_RAW_TEXT = "coalesce(Summary, '') || '. ' || coalesce(Text, '')"


@register("lemma_dictionary", V(f"""
select Id, {clean_text_sql(_RAW_TEXT, f"case when length(x) >= {FORM_LENGTH} then substr(x, 1, {LEMMA_LENGTH}) end")} as cleaned
from reviews""", "reviews"))
def q_lemma_dictionary(spark, d):
    """P3i with a dictionary table (here: long words to their stems); the rules only for words it lacks."""
    path = C._scratch(spark, "raw-tokens")  # cleaned once: the dictionary and the join both read it
    T.spread(T.reviews(spark, d)).select("Id", clean_text(full_text(), lemmatise=False).alias("cleaned")).write.parquet(path)
    raw = spark.read.parquet(path)
    forms = raw.select(F.explode(F.split("cleaned", " ")).alias("form")).filter(F.length("form") >= FORM_LENGTH).distinct()
    return lemmas.lemmatize_with(raw, forms.withColumn("lemma", F.substring("form", 1, LEMMA_LENGTH)))


# ------------------------------------------------------------------ files
@register("stats_file", V("""
select count(*) as total, count(*) filter (where split = 'train') as train,
       count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test,
       count(*) filter (where sentiment = 0) as negative, count(*) filter (where sentiment = 1) as neutral,
       count(*) filter (where sentiment = 2) as positive, round(avg(length(cleaned)), 6) as avg_cleaned_len
from splits""", "reviews", ctes={"cleaned": C._CLEANED_SQL, "splits": C._SPLIT_SQL}))
def q_stats_file(spark, d):
    """The preprocessing statistics written as a JSON record and read back."""
    from revlens.schemas import PREPROCESSING_STATS
    path = C._scratch(spark, "stats")
    files.write_json_record(profile.stats_record(profile.preprocessing_stats(C._split(spark, d))), path)
    return spark.read.schema(PREPROCESSING_STATS).json(path).select(
        "total", "train", "val", "test", "classes.negative", "classes.neutral", "classes.positive", "avg_cleaned_len")


@register("kpi_with_f1", V(f"""
select count(*) as totalPredictions, count(distinct ProductId) as uniqueProducts,
       round(count(*) filter (where inserted_at >= timestamp '{C.KPI_NOW}' - interval 60 seconds) / 60.0, 2) as throughput,
       round((select sum(f1 * support) / sum(support) from prf) * 100, 2) as f1Score
from predictions_keyed""", "predictions_big", "predictions_keyed",
                             ctes={"per_class": C._PER_CLASS_SQL, "prf": C._PRF_SQL}))
def q_kpi_with_f1(spark, d):
    """S13 + A13: the F1 of the stored model record, beside the table's figures."""
    from revlens.plans import training
    path = C._scratch(spark, "metadata")
    measured = evaluation.model_metrics(C._pb(spark, d), decimals=None).first()
    files.write_json_record(training.metadata_frame(spark, {"f1_test": measured["f1_weighted"]}), path)
    record = files.read_model_metadata(spark, path).first()
    return distribution.kpi(C._pk(spark, d), C.KPI_NOW, f1_score=record["f1_test"])


@register("test_export", V("""
select Id, ProductId, UserId, Time, Summary, Text, cast(prediction as integer) as sentiment, prediction, sentiment_label
from predictions_keyed""", "predictions_keyed"))
def q_test_export(spark, d):
    """The nine-column CSV of scored rows, read back."""
    from revlens.plans import scoring
    path = C._scratch(spark, "export")
    rows = C._pk(spark, d).withColumn("sentiment", F.col("prediction").cast("int"))
    scoring.export_test_predictions(rows, path)
    schema = StructType([rows.schema[c] for c in scoring.EXPORT_COLUMNS])
    return spark.read.schema(schema).options(**files.CSV_OPTIONS).csv(path)


@register("compacted_days", V("""
select strftime(inserted_at, '%Y-%m-%d') as day, count(*) as n, count(distinct ProductId) as products
from predictions_keyed group by 1""", "predictions_keyed"))
def q_compacted_days(spark, d):
    """The stored prediction table rewritten by ingest day."""
    src, dst = C._scratch(spark, "stored"), C._scratch(spark, "compact")
    (C._pk(spark, d).withColumn("batch_id", F.col("Id") % 3).write.partitionBy("batch_id").parquet(src))
    return (T.compact_predictions(spark, src, dst).groupBy(F.col("ingest_date").cast("string").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ProductId").alias("products")))


# ---------------------------------------------------------------- streams
@register("stream_replay", V("""
select Id, ProductId, prediction, cast(1 as bigint) as times, true as stamped from predictions_keyed""", "predictions_keyed"))
def q_stream_replay(spark, d):
    """S7 + P22 + T3s: two writers with their own checkpoints, a replayed batch, then a
    stream that tails the table: every row arrives once."""
    from revlens.streaming import monitors
    from revlens.streaming import scoring as sscore
    table = C._scratch(spark, "stored")
    rows = C._pk(spark, d)
    for part in (0, 1):
        mine = rows.filter(F.col("Id") % 2 == part)
        checkpoint = C._scratch(spark, "writer")
        sscore.start_stats_query(C._as_file_stream(spark, mine, "keyed-stream"), table, checkpoint,
                                 available_now=True).awaitTermination()
        sscore.write_stats_batch(mine, 0, table, sscore.run_name(spark, checkpoint))
    seen = C._scratch(spark, "tail")
    tail = monitors.tail_predictions(spark, table, max_files_per_trigger=C.MAX_FILES_PER_BATCH)
    monitors.start_append_query(tail.drop("run", "batch_id"), seen, C._scratch(spark, "tail-ckpt"),
                                available_now=True).awaitTermination()
    return (monitors.read_closed(spark, seen).groupBy("Id", "ProductId", "prediction")
            .agg(F.count(F.lit(1)).alias("times"), F.bool_and(F.col("inserted_at").isNotNull()).alias("stamped")))


@register("stream_batch_counts", V("""
select Id % 4 as batch_id, count(*) as written, cast(0 as bigint) as replayed from predictions_keyed group by 1""",
                                   "predictions_keyed"))
def q_stream_batch_counts(spark, d):
    """Rows of each stored micro-batch, counted while it is written; a replay writes none."""
    from revlens.streaming.scoring import write_stats_batch
    table, out = C._scratch(spark, "stored"), []
    for batch in range(4):
        rows = C._pk(spark, d).filter(F.col("Id") % 4 == batch)
        out.append((batch, *(write_stats_batch(rows, batch, table) for _ in range(2))))
    return spark.createDataFrame(out, "batch_id long, written long, replayed long")


# ----------------------------------------------------------------- models
_TEST_CTES = {"cleaned": C._CLEANED_SQL, "splits": C._SPLIT_SQL}


def _fitted(spark, d):
    """M4 + S14: naive Bayes on the balanced train split, saved and loaded; and the written split table."""
    from revlens.plans import training
    split = C._written_split(spark, d)
    path = C._scratch(spark, "model")
    training.save_model(training.fit_naive_bayes(training.training_tables(split)[0]), path)
    return training.load_model(path), split


@register("scored_rows", V("""
select Id, sentiment, true as labelled, true as confident from splits
where split = 'test' and cleaned is not null and cleaned <> ''""", "reviews", ctes=_TEST_CTES))
def q_scored_rows(spark, d):
    """M4 + M6 + P6 + S14: every usable test row is scored by the loaded model, with the label's
    name and a confidence from a third to one."""
    from revlens.functions.labels import label_name
    from revlens.plans import scoring
    model, split = _fitted(spark, d)
    scored = scoring.score(model, prep.drop_unusable(split.filter("split = 'test'")))
    return scored.select("Id", "sentiment", F.col("sentiment_label").eqNullSafe(label_name("prediction")).alias("labelled"),
                         F.col("confidence").between(1 / 3 - 1e-9, 1 + 1e-9).alias("confident"))


@register("stream_equals_batch", V("""
select Id, sentiment as true_sentiment, true as same, true as live from splits where split = 'test'""", "reviews",
                                   ctes=_TEST_CTES))
def q_stream_equals_batch(spark, d):
    """T1s as a single pass: the test split as messages, half without a cleaned text; the stored predictions
    equal the batch scores, and each has its live record."""
    from revlens.plans import scoring
    from revlens.streaming import scoring as sscore
    model, split = _fitted(spark, d)
    test = (T.reviews(spark, d).join(split.filter("split = 'test'"), "Id"))
    sent = test.withColumn("cleaned", F.when(F.col("Id") % 2 == 0, F.col("cleaned")))
    inbox, root = C._scratch(spark, "inbox"), C._scratch(spark, "stream")
    table, live = os.path.join(root, "predictions"), os.path.join(root, "live")
    messages.write_message_files(messages.publish_reviews(sent).repartition(4), inbox)
    sscore.start_single_pass(messages.message_files_source(spark, inbox, max_files_per_trigger=1), model, table, live,
                             os.path.join(root, "ckpt"), available_now=True).awaitTermination()
    batch = scoring.score(model, split.filter("split = 'test'")).select("Id", "prediction", "confidence")
    ids = (messages.normalise_live(spark.read.schema("key string, value string").json(live))
           .select(F.col("id").cast("long").alias("Id"), F.lit(True).alias("live")))
    stored = sscore.read_stats_table(spark, table).select("Id", "true_sentiment", F.col("prediction").alias("p"),
                                                          F.col("confidence").alias("c"))
    same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-9)
    return (stored.join(batch, "Id", "left").join(ids, "Id", "left")
            .select("Id", "true_sentiment", F.coalesce(same, F.lit(False)).alias("same"),
                    F.coalesce("live", F.lit(False)).alias("live")))
