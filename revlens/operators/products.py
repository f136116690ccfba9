"""Per-product queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS, label_or_neutral
from revlens.operators.feed import by_sentiment, format_prediction, newest_rows


def product_counts(pred: DataFrame) -> DataFrame:
    """Rows per product id (partial aggregation before the shuffle)."""
    return pred.groupBy(F.col("ProductId").alias("id")).agg(F.count(F.lit(1)).alias("count"))


def top_products(pred: DataFrame, sentiment: str | None = None, limit: int = 10) -> DataFrame:
    """Most reviewed products, optionally of one label; ties by id.

    groupBy + orderBy/limit plans as a partial/final aggregate followed by
    TakeOrderedAndProject, so only ``limit`` rows per task reach the driver.
    """
    return (product_counts(by_sentiment(pred, sentiment))
            .orderBy(F.desc("count"), F.asc_nulls_last("id"))
            .limit(limit))


def all_products(pred: DataFrame, limit: int = 2000) -> DataFrame:
    """Products by review count; a NULL id is dropped before the limit."""
    return (product_counts(pred.filter(F.col("ProductId").isNotNull() & (F.col("ProductId") != "")))
            .orderBy(F.desc("count"), F.asc("id"))
            .limit(limit))


def product_id_search(pred: DataFrame, q: str) -> DataFrame:
    """Distinct product ids containing ``q`` (case-insensitive), with counts."""
    hit = F.lower(F.col("ProductId")).contains(q.lower())
    return product_counts(pred.filter(F.col("ProductId").isNotNull() & hit))


def product_list(pred: DataFrame, limit: int = 10) -> DataFrame:
    """Top positive then top negative products, each id once, first list first."""
    pos = top_products(pred, "positive", limit).withColumn("src", F.lit(0))
    neg = top_products(pred, "negative", limit).withColumn("src", F.lit(1))
    both = pos.unionByName(neg)
    # Rank inside each source by the list order, then keep the first sighting of an id.
    both = both.withColumn("pos", F.row_number().over(
        Window.partitionBy("src").orderBy(F.desc("count"), F.asc("id"))))
    first = F.row_number().over(Window.partitionBy("id").orderBy("src", "pos"))
    return (both.withColumn("k", first).filter("k = 1")
            .select("id", "count", "src", "pos").orderBy("src", "pos"))


def product_summary(pred: DataFrame, product_id: str) -> DataFrame:
    """A22 (totals): one row with total and per-label counts; empty when the product is unknown."""
    df = pred.filter(F.col("ProductId") == product_id)
    agg = df.agg(F.count(F.lit(1)).alias("totalReviews"),
                 *[F.count_if(F.col("sentiment_label") == n).alias(n) for n in LABELS])
    return agg.filter(F.col("totalReviews") > 0).select(F.lit(product_id).alias("id"), "*")


def product_yearly(pred: DataFrame, product_id: str) -> DataFrame:
    """A22 (yearly breakdown): year x label counts of one product (null label = neutral)."""
    from revlens.operators.trends import with_review_time
    df = with_review_time(pred.filter(F.col("ProductId") == product_id))
    lab = label_or_neutral("sentiment_label")
    return (df.groupBy(F.year(F.timestamp_seconds("_t")).cast("string").alias("year"))
            .agg(*[F.count_if(lab == n).alias(n) for n in ("positive", "neutral", "negative")])
            .orderBy("year"))


def product_page_counts(pred: DataFrame, product_id: str) -> DataFrame:
    """A22 totals and yearly breakdown from one scan (``rollup`` over the year).

    Rows: level 'total' (all of the product's rows; label counts as stored)
    and one 'year' row per usable review year (missing label counts as
    neutral, T4). Same numbers as ``product_summary`` + ``product_yearly``,
    one aggregate instead of two scans.
    """
    from revlens.functions.timefn import normalise_time
    df = (pred.filter(F.col("ProductId") == product_id)
          .withColumn("year", F.year(F.timestamp_seconds(normalise_time("Time"))).cast("string")))
    lab, lab_n = F.col("sentiment_label"), label_or_neutral("sentiment_label")
    agg = (df.rollup("year")
           .agg(F.grouping("year").alias("_g"), F.count(F.lit(1)).alias("totalReviews"),
                *[F.count_if(lab == n).alias(f"_{n}") for n in LABELS],
                *[F.count_if(lab_n == n).alias(f"_{n}_t") for n in LABELS]))
    total = F.col("_g") == 1
    return (agg.filter(total | F.col("year").isNotNull())
            .select(F.when(total, F.lit("total")).otherwise(F.lit("year")).alias("level"),
                    F.when(total, F.lit(None)).otherwise(F.col("year")).cast("string").alias("year"),
                    "totalReviews",
                    *[F.when(total, F.col(f"_{n}")).otherwise(F.col(f"_{n}_t")).alias(n) for n in LABELS])
            .filter(F.col("totalReviews") > 0))


def product_newest(pred: DataFrame, product_id: str, limit: int = 20) -> DataFrame:
    """A22 (reviews): the newest ``limit`` reviews of one product by Time, Id breaks ties."""
    df = pred.filter(F.col("ProductId") == product_id)
    return format_prediction(newest_rows(df, limit, "Time"))


def product_detail(pred: DataFrame, product_id: str) -> dict[str, DataFrame]:
    """The three parts of a product page (each one filtered scan)."""
    return {"summary": product_summary(pred, product_id),
            "yearly": product_yearly(pred, product_id),
            "reviews": product_newest(pred, product_id)}


def product_reviews(pred: DataFrame, product_id: str, sentiment: str | None = None,
                    page: int = 1, page_size: int = 20) -> DataFrame:
    """L3 / L4: one page of a product's reviews, newest first, with the filtered total.

    The page comes from ``newest_rows``: the page's oldest time is found from
    the Time column, and whole rows are read only from there on (a product
    holding a third of the table does not have all its texts read for one
    page); then an ordered offset + limit. The total is a count over the same
    filter, as a scalar subquery.
    """
    page = max(1, int(page))
    df = by_sentiment(pred.filter(F.col("ProductId") == product_id), sentiment)
    rows = newest_rows(df, page_size, "Time", offset=(page - 1) * page_size)
    total = df.agg(F.count(F.lit(1))).scalar()
    return (format_prediction(rows).withColumn("total", total)
            .withColumn("page", F.lit(page)).withColumn("pageSize", F.lit(page_size)))
