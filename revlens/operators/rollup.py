"""Incremental rollup of the prediction table (A13-A17, A21) and its queries.

Every batch is counted once, when it is stored, on two levels: (review day, label,
confidence bin) and (product, label). The queries add up these partial counts and read no
review row; a partial count of a batch and the sum of many have the same shape, so that
merged parts are rolled up again without loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS, label_or_neutral
from revlens.functions.timefn import MONTHS, normalise_time
from revlens.operators.evaluation import CONF_BINS, _conf_bin
from revlens.operators.grids import grid, zero_fill

DAY_LEVEL, PRODUCT_LEVEL = "day", "product"
PARTS = "level string, day date, product string, label string, bin int, n long"
KEYS = ["level", "day", "product", "label", "bin"]


def partial_counts(pred: DataFrame) -> DataFrame:
    """The counts of one batch on both levels, in one aggregate (``PARTS``).

    ``day`` is the date of the repaired review time (P12), NULL when unusable; labels and
    products stay as stored, NULL included.
    """
    rows = pred.select(F.to_date(F.timestamp_seconds(normalise_time("Time"))).alias("day"), F.col("ProductId").alias("product"),
                       F.col("sentiment_label").alias("label"), _conf_bin("confidence").cast("int").alias("bin"))
    by_product = F.grouping("bin") == 1
    sets = rows.groupingSets([["day", "label", "bin"], ["product", "label"]], "day", "product", "label", "bin")
    return (sets.agg(F.count(F.lit(1)).alias("n"), by_product.alias("_p"))
            .select(F.when(F.col("_p"), PRODUCT_LEVEL).otherwise(DAY_LEVEL).alias("level"), "day", "product", "label", "bin", "n"))


def merged(parts: DataFrame) -> DataFrame:
    """Partial counts added up, in the same shape."""
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def _days(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("level") == DAY_LEVEL)


def _sums(label, names) -> list:
    return [F.coalesce(F.sum(F.when(label == name, F.col("n"))), F.lit(0)).alias(name) for name in names]


def total(parts: DataFrame) -> DataFrame:
    """All rows."""
    return _days(parts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("totalPredictions"))


def global_distribution(parts: DataFrame) -> DataFrame:
    """A14."""
    return _days(parts).agg(*_sums(F.col("label"), LABELS))


def yearly_trend(parts: DataFrame) -> DataFrame:
    """A15."""
    return (_days(parts).filter("day is not null").groupBy(F.year("day").cast("string").alias("year"))
            .agg(*_sums(label_or_neutral("label"), ("positive", "neutral", "negative"))).orderBy("year"))


def monthly_trend(parts: DataFrame, year: int) -> DataFrame:
    """Twelve months, zero-filled."""
    counts = (_days(parts).filter(F.year("day") == year).groupBy(F.month("day").alias("month_num"))
              .agg(*_sums(label_or_neutral("label"), ("positive", "neutral", "negative"))))
    months = grid(parts.sparkSession, month_num=list(range(1, 13)))
    out = zero_fill(counts, months, ["month_num"], ["positive", "neutral", "negative"])
    names = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("month_num").cast("int"))
    return out.select(F.col("month_num").cast("int").alias("month_num"), names.alias("month"), "positive", "neutral", "negative")


def top_products(parts: DataFrame, sentiment: str | None = None, limit: int = 10) -> DataFrame:
    """Ties by id."""
    rows = parts.filter(F.col("level") == PRODUCT_LEVEL)
    if sentiment and sentiment != "all":
        rows = rows.filter(F.col("label") == sentiment)
    return (rows.groupBy(F.col("product").alias("id")).agg(F.sum("n").alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("id")).limit(limit))


def confidence_histogram(parts: DataFrame) -> DataFrame:
    """A21."""
    counts = _days(parts).filter(F.col("label").isin(*LABELS)).groupBy("label", "bin").agg(F.sum("n").alias("n"))
    axes = grid(parts.sparkSession, label=LABELS, bin=list(range(len(CONF_BINS))))
    out = zero_fill(counts, axes, ["label", "bin"], ["n"])
    edges = F.element_at(F.array(*[F.lit(b) for b in CONF_BINS]), F.col("bin").cast("int") + 1)
    return out.select("label", F.col("bin").cast("int").alias("bin"), edges.alias("bin_start"), "n")
