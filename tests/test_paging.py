"""Pages by the rank index: equal to the full sort, and what they read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import paging, products
from revlens.schemas import PREDICTION
from test_textindex import scanned_rows

DAY = 86400


def corpus(rng, n):
    """Ties in time, NULL and negative times, milliseconds, NULL products and labels, repeated rows."""
    def time(i):
        return rng.choice([None, -5, 1_300_000_000_000 + i]) if i % 11 == 0 else 1_000_000_000 + rng.randrange(40) * DAY + rng.choice([0, 0, 7, i])
    rows = [(i, rng.choice(["p", "p", "q", None]), "u", time(i), "s", "t", "c", 1, 1.0, rng.choice(["neutral", "positive", None, ""]), 0.5, None)
            for i in range(n)]
    return rows + [(3, "p", "u", 1_000_000_000, "s", "t", "c", 1, 1.0, "neutral", 0.5, None)] * 5


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = os.path.join(str(tmp_path_factory.mktemp("paging")), "rows")
    frame = spark.createDataFrame(corpus(random.Random(6), 900), PREDICTION)
    frame.repartitionByRange(10, "ProductId", "Time").sortWithinPartitions("ProductId", "Time").write.parquet(path)
    rows = spark.read.schema(PREDICTION).parquet(path)
    counts = paging.page_counts(rows.filter("Id < 400 or Id is null")).union(paging.page_counts(rows.filter("Id >= 400")))
    return rows, counts.cache()


@pytest.mark.parametrize("few", [10_000, 0])
def test_pages_equal_the_full_sort(table, monkeypatch, few):
    monkeypatch.setattr(paging, "FEW", few)
    rows, counts = table
    for product, sentiment, size in (("p", None, 20), ("p", "neutral", 7), ("q", "all", 50), ("none", None, 5)):
        total = rows.filter(F.col("ProductId") == product).count() if sentiment != "neutral" else \
            rows.filter((F.col("ProductId") == product) & (F.col("sentiment_label") == sentiment)).count()
        last = max(1, -(-total // size))
        for page in sorted({0, 1, 2, last // 2 + 1, last, last + 1}):
            got = paging.product_page(rows, counts, product, sentiment, page, size)
            want = products.product_reviews(rows, product, sentiment, page, size)
            assert got.columns == want.columns
            # Repeated rows are equal in every column, so the order of both is one.
            assert got.collect() == want.collect(), (product, sentiment, page)


def test_merged_counts_give_the_same_page(table):
    rows, counts = table
    assert paging.product_page(rows, paging.merged(counts), "p", page=3).collect() == paging.product_page(rows, counts, "p", page=3).collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], PREDICTION)
    assert paging.product_page(none, paging.page_counts(none), "p").count() == 0


def test_only_the_pages_days_are_read(spark, tmp_path):
    rows = [(i, "hot", "u", 1_000_000_000 + i * 600, "s", "t", "c", 1, 1.0, "neutral", 0.5, None) for i in range(20_000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, PREDICTION).repartitionByRange(40, "Time").sortWithinPartitions("Time").write.parquet(path)
    table = spark.read.schema(PREDICTION).parquet(path)
    page = paging.product_page(table, paging.page_counts(table).cache(), "hot", page=500)
    assert [r.id for r in page.collect()] == [str(i) for i in range(10_019, 9_999, -1)]
    again = paging.product_page(table, paging.page_counts(table).cache(), "hot", page=500)  # run once, so that its scan runs
    assert 0 < scanned_rows(again, "Text") <= 1500
    assert scanned_rows(products.product_reviews(table, "hot", page=500), "Text") > 9000
