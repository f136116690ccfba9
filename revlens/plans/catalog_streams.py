"""Registered queries, fourth part: what streams reject, receive twice and report of themselves; lemmas decided by the corpus.

Importing the module adds them to ``catalog.REGISTRY``.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from revlens.functions.text import IRREGULAR_LEMMAS, SINGULAR_S, clean_text, clean_text_sql, full_text
from revlens.operators import lemmas, quality
from revlens.plans import catalog as C
from revlens.sources import files, messages
from revlens.sources import tables as T

V, register = T.with_views, C.register


# ---------------------------------------------------------------- rejected
def _damaged_messages(spark, d):
    """Every review as a message; of ten ids one each is cut short, has no value, a text as id, no id, or is a list."""
    rows = T.reviews(spark, d).withColumns({"cleaned": F.coalesce("Summary", F.lit("none")), "sentiment": F.lit(1)})
    kind = F.col("Id") % 10
    sent = messages.publish_reviews(rows).select("key", "value", F.get_json_object("value", "$.Id").cast("long").alias("Id"))
    value = F.col("value")
    return sent.select("key", F.when(kind == 0, F.left(value, F.length(value) - 5))
                       .when(kind == 1, F.lit(None).cast("string"))
                       .when(kind == 2, F.to_json(F.struct(F.concat(F.lit("x"), F.col("Id").cast("string")).alias("Id"))))
                       .when(kind == 3, F.lit('{"Summary":"no id"}')).when(kind == 4, F.lit("[1, 2]")).otherwise(value).alias("value"))


@register("rejected_messages", V("""
select case Id % 10 when 0 then 'not json' when 1 then 'no value' when 2 then 'wrong type' when 3 then 'no id' when 4 then 'wrong type'
       else 'scored' end as outcome, count(*) as n from reviews group by 1
union all select 'live', count(*) from reviews where Id % 10 > 4
union all select 'received', count(*) from reviews""", "reviews"))
def q_rejected_messages(spark, d):
    """What is no review goes to the rejected table with its reason and is never scored: scored + rejected = received."""
    from revlens.plans import training
    from revlens.streaming import scoring as sscore
    few = T.labelled_reviews(spark, d).select(F.coalesce("Summary", F.lit("none")).alias("cleaned"), "sentiment")
    model = training.fit_naive_bayes(few)
    inbox, root = C._scratch(spark, "inbox"), C._scratch(spark, "stream")
    messages.write_message_files(_damaged_messages(spark, d).repartition(4), inbox)
    raw = messages.message_files_source(spark, inbox, max_files_per_trigger=2)
    table, live, bad = (os.path.join(root, n) for n in ("predictions", "live", "rejected"))
    sscore.start_single_pass(raw, model, table, live, os.path.join(root, "ckpt"), available_now=True, rejected_path=bad).awaitTermination()
    counts = lambda df, outcome: df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return (counts(spark.read.parquet(bad), F.col("reason"))
            .unionByName(counts(sscore.read_stats_table(spark, table).filter("prediction is not null"), F.lit("scored")))
            .unionByName(counts(spark.read.schema(messages.MESSAGE_SCHEMA).json(live).filter("value is not null"), F.lit("live")))
            .unionByName(counts(spark.read.schema(messages.MESSAGE_SCHEMA).json(inbox), F.lit("received"))))


# -------------------------------------------------------------- redelivery
AGAIN_HOURS, DELAY = 3, "12 hours"


@register("stream_redelivery", V("""
select Id, cast(1 as bigint) as times from predictions_keyed""", "predictions_keyed"))
def q_stream_redelivery(spark, d):
    """T1s / T3s: three of ten messages are sent again hours later, into later batches; every row arrives once."""
    from revlens.streaming import monitors
    from revlens.streaming import scoring as sscore
    rows = C._pk(spark, d).select("Id", "inserted_at")
    later = rows.filter(F.col("Id") % 10 < 3).withColumn("inserted_at", F.col("inserted_at") + F.expr(f"interval {AGAIN_HOURS} hours"))
    stream = C._as_file_stream(spark, rows.unionByName(later), "redelivered")
    seen = C._scratch(spark, "once")
    monitors.start_append_query(sscore.once_per_message(stream, "inserted_at", DELAY), seen, C._scratch(spark, "once-ckpt"),
                                available_now=True).awaitTermination()
    return monitors.read_closed(spark, seen).groupBy("Id").agg(F.count(F.lit(1)).alias("times"))


# -------------------------------------------------------------- latest rows
@register("product_counters_latest", V("""
select coalesce(ProductId, '') as product, coalesce(sentiment_label, 'unknown') as label, count(*) as count
from predictions_keyed group by all""", "predictions_keyed"))
def q_product_counters_latest(spark, d):
    """T4s in update mode: running counts per product and label; a batch writes the counts that changed, the read takes the newest."""
    from revlens.sources.latest import LatestTable, start_latest_query
    stream = C._as_file_stream(spark, C._pk(spark, d), "keyed-stream")
    counts = (stream.groupBy(F.coalesce("ProductId", F.lit("")).alias("product"), F.coalesce("sentiment_label", F.lit("unknown")).alias("label"))
              .count())
    table = LatestTable(spark, C._scratch(spark, "latest"), ["product", "label"], counts.schema, fan=2)
    start_latest_query(counts, table, C._scratch(spark, "latest-ckpt"), available_now=True).awaitTermination()
    return table.read()


# ---------------------------------------------------------------- progress
@register("traffic_of_stream", V("""
select status, (select count(*) from predictions_keyed) as messages from (values ('ok'), ('fail')) s(status)""", "predictions_keyed"))
def q_traffic_of_stream(spark, d):
    """T2s / Q2 / Q3: a real stream and its idle time, from the snapshots of the query listener: the last total that grew, and the
    total that did not."""
    from revlens.streaming.progress import ProgressLog, snapshots, wait_for
    inbox, out, table = C._scratch(spark, "inbox"), C._scratch(spark, "received"), C._scratch(spark, "progress")
    C._pk(spark, d).select(F.col("ProductId").alias("key"), F.to_json(F.struct("Id")).alias("value")).repartition(3).write.json(inbox)
    name = os.path.basename(inbox)
    log = ProgressLog(spark, table, {name: "reviews"})
    spark.streams.addListener(log)
    try:
        q = (messages.message_files_source(spark, inbox, max_files_per_trigger=1).writeStream.queryName(name).format("parquet")
             .option("path", out).option("checkpointLocation", C._scratch(spark, "received-ckpt"))
             .trigger(processingTime="200 milliseconds").start())
        q.processAllAvailable()
        # An idle report follows the last batch's.
        have = log.reports.get("reviews", 0)
        wait_for(lambda: log.reports.get("reviews", 0) >= max(have + 1, 4))
        q.stop()
        q.awaitTermination()
    finally:
        spark.streams.removeListener(log)
    runs = quality.traffic(snapshots(spark, table))
    totals = runs.withColumn("messages", F.regexp_extract("detail", "offset (\\d+)", 1).cast("long"))
    return totals.groupBy("status").agg(F.max("messages").alias("messages"))


# ------------------------------------------------------------------ lemmas
_RAW = "coalesce(Summary, '') || '. ' || coalesce(Text, '')"
_IRREGULAR_SQL = ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR_LEMMAS.items())
_SINGULAR_SQL = ", ".join(f"'{w}'" for w in SINGULAR_S)


@register("corpus_lemmas", V(f"""
select r.Id, coalesce(x.lemmas, '') as cleaned from raw r left join (
  select Id, string_agg(coalesce(i.lemma, p.base, t.w), ' ' order by t.pos) as lemmas
  from tok t left join irregular i on i.form = t.w left join pick p on p.w = t.w group by Id) x on x.Id = r.Id""", "reviews", ctes={
    # The cleaning chain without its last step: every token is its own lemma.
    "raw": f"select Id, {clean_text_sql(_RAW, 'x')} as t from reviews",
    "tok": "select Id, w, pos from (select Id, unnest(string_split(t, ' ')) as w, generate_subscripts(string_split(t, ' '), 1) as pos from raw) where w <> ''",
    "vocab": "select w, count(*) as n from tok group by w",
    "irregular": f"select form, lemma from (values {_IRREGULAR_SQL}) v(form, lemma)",
    "plural": f"""select w, left(w, -1) as one, left(w, -2) as two, left(w, -3) as three from vocab
       where w not in ({_SINGULAR_SQL}) and w not in (select form from irregular)""",
    "maybe": r"""
       select w, one as base from plural where regexp_matches(w, '[^s]s$')
       union select w, two from plural where regexp_matches(w, '(s|x|z|ch|sh|o)es$')
       union select w, two || 'is' from plural where regexp_matches(w, 'ses$')
       union select w, three from plural where regexp_matches(w, 'zzes$')
       union select w, three || unnest(['f', 'fe']) from plural where regexp_matches(w, 'ves$')
       union select w, three || 'y' from plural where regexp_matches(w, 'ies$')
       union select w, two || 'an' from plural where regexp_matches(w, 'men$')""",
    "pick": """select m.w, m.base from maybe m join vocab v on v.w = m.base
       qualify row_number() over (partition by m.w order by v.n desc, m.base) = 1"""}))
def q_corpus_lemmas(spark, d):
    """P3i decided by the corpus: plural endings are detached where the base is a word of the texts."""
    raw = T.spread(T.reviews(spark, d)).select("Id", clean_text(full_text(), lemmatise=False).alias("cleaned"))
    stored = C._scratch(spark, "tokens")
    raw.write.parquet(stored)  # cleaned once, read for the vocabulary, the tokens and the result
    return lemmas.lemmatize_by_corpus(spark.read.parquet(stored))


# ---------------------------------------------------------------- metadata
@register("metadata_records", """
select n_name as name, case when n_nationkey % 3 = 0 then 'LogisticRegression' else 'NaiveBayes' end as model_type,
       case when n_nationkey % 4 = 0 then 0.8274 else n_nationkey / 100.0 end as f1_score, cast(0.85 as double) as accuracy,
       n_nationkey % 2 = 0 as is_active, case when n_nationkey % 5 = 0 then '' else 'region ' || n_regionkey end as notes
from nation""")
def q_metadata_records(spark, d):
    """A metadata file with a list of records, some without a field or with null; what is missing gets its default."""
    key = F.col("n_nationkey")
    record = F.struct(F.col("n_name").alias("name"), F.when(key % 3 != 0, F.lit("NaiveBayes")).alias("model_type"),
                      F.when(key % 4 != 0, key / 100).alias("f1_score"), F.when(key % 2 != 0, F.lit(False)).alias("is_active"),
                      F.when(key % 5 != 0, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("notes"))
    path = C._scratch(spark, "metadata")
    T.table(spark, d, "nation").agg(F.to_json(F.collect_list(record)).alias("value")).coalesce(1).write.text(path)
    return files.load_metadata(spark, path).drop("trained_at")
