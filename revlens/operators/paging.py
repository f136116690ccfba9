"""Pages of a product's reviews by a rank index (L3, L4): only the time buckets that a page lies in are read.

The index counts rows by (product, label, day of the stored time). The running total of a
product's days, newest first, names the days that hold rows ``offset`` .. ``offset + size``; their time range
reaches the scan, and the page is cut out of their rows. Days with very many rows are
counted once more by exact time. Partial counts of batches add up, so that the index is kept as rows are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.feed import by_product, by_sentiment, format_prediction

DAY = 86400
#: More rows than this in a page's buckets are counted by exact time first.
FEW = 10_000
COUNTS = "product string, label string, bucket long, n long"


def page_counts(pred: DataFrame, width: int = DAY) -> DataFrame:
    """``COUNTS`` of (a batch of) predictions; rows without a time are in the bucket NULL."""
    time = F.col("Time")
    bucket = F.call_function("div", time - F.pmod(time, F.lit(width)), F.lit(width))
    return (pred.groupBy(F.col("ProductId").alias("product"), F.col("sentiment_label").alias("label"), bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("product", "label", "bucket").agg(F.sum("n").alias("n"))


def _located(counts: DataFrame, first: int, last: int) -> dict:
    """Of buckets (bucket, n) newest first, NULL last: the range that holds rows ``first`` .. ``last``, and the rows before it."""
    newest = Window.orderBy(F.desc_nulls_last("bucket"))  # the buckets of one product
    upto = counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(newest))
    here = (F.col("upto") > first) & (F.col("upto") - F.col("n") < last)
    row = upto.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min(F.when(here, F.col("bucket"))).alias("low"),
                   F.max(F.when(here, F.col("bucket"))).alias("high"), F.min(F.when(here, F.col("upto") - F.col("n"))).alias("before"),
                   F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("rows"),
                   F.coalesce(F.bool_or(here & F.col("bucket").isNull()), F.lit(False)).alias("unknown")).first()
    return row.asDict()


def _within(rows: DataFrame, at: dict, width: int) -> DataFrame:
    time, keep = F.col("Time"), F.lit(False)
    if at["low"] is not None:
        keep = time.between(at["low"] * width, at["high"] * width + width - 1)
    return rows.filter(keep | time.isNull() if at["unknown"] else keep)


def product_page(pred: DataFrame, counts: DataFrame, product_id: str, sentiment: str | None = None, page: int = 1,
                 page_size: int = 20) -> DataFrame:
    """One page of a product's reviews, newest first (ties: the larger id), with the filtered total: equal to
    ``products.product_reviews``. ``counts`` are the ``page_counts`` of ``pred``, merged or not. A page past the end is empty."""
    page = max(1, int(page))
    first = (page - 1) * page_size
    mine = counts.filter(F.col("product") == product_id)
    if sentiment and sentiment != "all":
        mine = mine.filter(F.col("label") == sentiment)
    at = _located(mine, first, first + page_size)
    total, skipped = at["total"], at["before"] or 0
    rows = _within(by_sentiment(by_product(pred, product_id), sentiment), at, DAY)
    if at["rows"] > FEW:
        exact = _located(page_counts(rows.select("ProductId", "sentiment_label", "Time"), 1), first - skipped, first + page_size - skipped)
        rows, skipped = _within(rows, exact, 1), skipped + (exact["before"] or 0)
    cut = rows.orderBy(F.desc_nulls_last("Time"), F.desc("Id")).offset(first - skipped).limit(page_size)
    return (format_prediction(cut).withColumn("total", F.lit(total).cast("long")).withColumn("page", F.lit(page))
            .withColumn("pageSize", F.lit(page_size)))
