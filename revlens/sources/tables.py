"""Table scans and adapters from the shared test tables to the engine's record shapes.

``predictions_big`` (from ``lineitem``), ``predictions_keyed`` (from
``events``) and ``reviews`` (from ``documents``) are plain projections:
they add no shuffle and keep Catalyst free to prune columns and push
filters into the parquet scan underneath.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.labels import label_name, score_to_label
from revlens.functions.timefn import epoch_seconds

REVIEW_EPOCH0 = 946684800  # 2000-01-01, base of the derived review Time
DAY = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread CPU-heavy row work (regex cleaning, feature hashing) over the cluster.

    Large inputs already arrive in many scan splits and pass through
    untouched; only an input with fewer partitions than the cluster has
    cores (a small file holding long texts) is round-robin repartitioned.
    """
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. Spark Connect): leave the plan alone
        return df
    if have < want:
        # The always-true filter on the (non-deterministic) partition id keeps
        # Catalyst from pushing later predicates -- and the text cleaning inside
        # them -- back below the exchange into the single scan task.
        return df.repartition(want).filter(F.spark_partition_id() >= 0)
    return df


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The stored prediction table (parquet, partitioned by batch_id)."""
    return spark.read.parquet(path)


def compact_predictions(spark: SparkSession, src: str, dst: str, files_per_day: int | None = None,
                        mode: str = "overwrite") -> DataFrame:
    """Rewrite the stream's batch_id-partitioned prediction table for reading.

    Output: partitioned by ingest date, each day range-clustered and sorted by
    (ProductId, Time, Id), with a Parquet bloom filter on ProductId. Product
    pages and product filters (``ProductId = x``) then skip whole files
    and row groups by min/max statistics and the bloom filter; trend queries
    prune by date. Runs as one range-partitioned shuffle; it is a written
    table, so later jobs start from it instead of the micro-batch lineage.

    ``files_per_day`` (despite its name) is the number of ranges over the
    whole table; a day gets about its share of them. By default it is the
    session's shuffle width (sized from the input by
    ``session.apply_scale_conf``) or the core count, whichever is larger, so
    each range -- and its sort -- stays at shuffle-partition size.
    """
    df = spark.read.parquet(src)
    df = df.drop("batch_id") if "batch_id" in df.columns else df
    df = df.withColumn("ingest_date", F.to_date(F.col("inserted_at")))
    n = files_per_day or max(spark.sparkContext.defaultParallelism,
                             int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = (df.repartitionByRange(n, "ingest_date", "ProductId", "Time", "Id")
           .sortWithinPartitions("ingest_date", "ProductId", "Time"))
    (out.write.mode(mode).partitionBy("ingest_date")
     .option("parquet.bloom.filter.enabled#ProductId", "true")
     .parquet(dst))
    return spark.read.parquet(dst)


def predictions_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-shaped view over ``lineitem`` (volume; no unique key)."""
    li = table(spark, sf_dir, "lineitem")
    score = F.lit(1) + F.col("l_quantity").cast("int") % 5
    prediction = (F.when(F.col("l_returnflag") == "A", F.lit(0.0))
                  .when(F.col("l_returnflag") == "N", F.lit(1.0))
                  .when(F.col("l_returnflag") == "R", F.lit(2.0)))
    return (li.select(
        F.col("l_orderkey").alias("Id"),
        F.col("l_partkey").cast("string").alias("ProductId"),
        F.col("l_suppkey").cast("string").alias("UserId"),
        epoch_seconds("l_shipdate").alias("Time"),
        score_to_label(score).alias("true_sentiment"),
        prediction.alias("prediction"),
        F.round(F.lit(0.475) + F.col("l_discount") * 5, 3).alias("confidence"),
    ).withColumn("sentiment_label", label_name("prediction")))


def predictions_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-shaped view over ``events`` (event_id and ts are unique)."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    prediction = (F.when(et.isin("purchase", "signup"), F.lit(2.0))
                  .when(et.isin("view", "click"), F.lit(1.0))
                  .when(et == "error", F.lit(0.0)))
    return (ev.select(
        F.col("event_id").alias("Id"),
        F.get_json_object("props", "$.k").alias("ProductId"),
        F.col("user_id").cast("string").alias("UserId"),
        epoch_seconds("ts").alias("Time"),
        et.alias("Summary"),
        F.col("props").alias("Text"),
        F.lit(None).cast("string").alias("cleaned"),
        F.lit(None).cast("int").alias("true_sentiment"),
        prediction.alias("prediction"),
        F.least(F.lit(0.99), F.lit(0.5) + F.col("value") / 1000).alias("confidence"),
        F.col("ts").cast("timestamp").alias("inserted_at"),
    ).withColumn("sentiment_label", label_name("prediction")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-review-shaped view over ``documents`` (text for cleaning and training)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("Id"),
        F.col("source").alias("ProductId"),
        F.col("lang").alias("UserId"),
        (F.lit(REVIEW_EPOCH0) + F.lit(DAY) * F.col("doc_id")).alias("Time"),
        (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("Score"),
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("Summary"),
        F.col("text").alias("Text"),
    )


def labelled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews`` plus the 0/1/2 label derived from Score."""
    return reviews(spark, sf_dir).withColumn("sentiment", score_to_label("Score"))


# The same adapters as SQL text, for the DuckDB oracle (tables are views there).
PREDICTIONS_BIG_SQL = """
select l_orderkey as Id, cast(l_partkey as varchar) as ProductId, cast(l_suppkey as varchar) as UserId,
       epoch_us(l_shipdate) // 1000000 as Time,
       case when 1 + cast(l_quantity as integer) % 5 < 3 then 0
            when 1 + cast(l_quantity as integer) % 5 = 3 then 1 else 2 end as true_sentiment,
       cast(case l_returnflag when 'A' then 0.0 when 'N' then 1.0 when 'R' then 2.0 end as double) as prediction,
       round(0.475 + l_discount * 5, 3) as confidence,
       case l_returnflag when 'A' then 'negative' when 'N' then 'neutral' when 'R' then 'positive' end
         as sentiment_label
from lineitem"""

PREDICTIONS_KEYED_SQL = """
select event_id as Id, json_extract_string(props, '$.k') as ProductId, cast(user_id as varchar) as UserId,
       epoch_us(ts) // 1000000 as Time, event_type as Summary, props as Text,
       cast(null as varchar) as cleaned, cast(null as integer) as true_sentiment,
       cast(case when event_type in ('purchase', 'signup') then 2.0 when event_type in ('view', 'click') then 1.0
            when event_type = 'error' then 0.0 end as double) as prediction,
       least(0.99, 0.5 + value / 1000) as confidence, ts as inserted_at,
       case when event_type in ('purchase', 'signup') then 'positive'
            when event_type in ('view', 'click') then 'neutral'
            when event_type = 'error' then 'negative' end as sentiment_label
from events"""

REVIEWS_SQL = f"""
select doc_id as Id, source as ProductId, lang as UserId, {REVIEW_EPOCH0} + {DAY} * doc_id as Time,
       cast(1 + doc_id % 5 as integer) as Score, case when doc_id % 10 <> 0 then source end as Summary, text as Text,
       case when 1 + doc_id % 5 < 3 then 0 when 1 + doc_id % 5 = 3 then 1 else 2 end as sentiment
from documents"""


def with_views(sql: str, *names: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix an oracle query with the adapter CTEs it uses (then any extra CTEs)."""
    defs = {"predictions_big": PREDICTIONS_BIG_SQL, "predictions_keyed": PREDICTIONS_KEYED_SQL,
            "reviews": REVIEWS_SQL}
    parts = [f"{n} as ({defs[n]})" for n in names]
    parts += [f"{n} as ({q})" for n, q in (ctes or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + sql
