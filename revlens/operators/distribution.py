"""Label and score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS
from revlens.functions.mathfn import share


def score_distribution(df: DataFrame, score_col: str = "Score") -> DataFrame:
    """A1: rows per star score, ordered by score."""
    return (df.groupBy(F.col(score_col).alias("Score"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("Score"))


def class_distribution(df: DataFrame, label_col: str = "sentiment", decimals: int = 1) -> DataFrame:
    """A2: rows per class and their share of all rows (percent, half-up).

    The total is a scalar subquery over the aggregated rows (one per class);
    Spark reuses the aggregate's exchange for it.
    """
    agg = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = agg.agg(F.sum("n")).scalar()
    return (agg.withColumn("_total", total)
            .withColumn("pct", share("n", "_total", 100, decimals)).drop("_total")
            .orderBy("label"))


def prediction_distribution(pred: DataFrame) -> DataFrame:
    """Rows per predicted label name, most frequent first."""
    return (pred.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last("sentiment_label")))


def global_distribution(pred: DataFrame) -> DataFrame:
    """One row, count per known label (zero when absent); unknown labels ignored."""
    return pred.agg(*[F.count_if(F.col("sentiment_label") == n).alias(n) for n in LABELS])


def label_shares(pred: DataFrame, decimals: int = 1) -> DataFrame:
    """Per label, count and percent of the known-label total (0 when empty)."""
    g = global_distribution(pred)
    total = F.col("negative") + F.col("neutral") + F.col("positive")
    stacked = g.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("label"), F.col(n).alias("n"), share(n, total, 100, decimals).alias("pct"))
        for n in LABELS])).alias("s"))
    return stacked.select("s.label", "s.n", "s.pct")


def kpi(pred: DataFrame, now=None, f1_score: float | None = None, window_s: int = 60) -> DataFrame:
    """Total rows, distinct products, rows per second over the last minute
    (rounded to 2) and, when given, the model F1 as a percentage.

    ``now`` defaults to the clock. One pass: count,
    count(distinct ProductId) (map-side de-duplicated before the shuffle,
    so a dominant product costs nothing extra) and a conditional count.
    """
    from revlens.operators.quality import with_now
    p = with_now(pred, now)
    recent = F.count_if(F.col("inserted_at").cast("timestamp")
                        >= F.col("_now") - F.expr(f"INTERVAL {int(window_s)} SECONDS"))
    out = p.agg(F.count(F.lit(1)).alias("totalPredictions"),
                F.countDistinct("ProductId").alias("uniqueProducts"),
                F.round(recent / F.lit(float(window_s)), 2).alias("throughput"))
    if f1_score is not None:
        out = out.withColumn("f1Score", F.round(F.lit(float(f1_score)) * 100, 2))
    return out


def product_vs_global(pred: DataFrame, product_id: str, decimals: int = 1) -> DataFrame:
    """Label shares of one product beside the shares of all products.

    One scan and one aggregate: each label is counted over all rows and over
    the product's, then the one row is turned into three.
    """
    lab, own = F.col("sentiment_label"), F.col("ProductId") == product_id
    counts = pred.agg(*[c for n in LABELS for c in (F.count_if(lab == n).alias(f"g_{n}"),
                                                    F.count_if(own & (lab == n)).alias(f"p_{n}"))])
    total = {side: sum((F.col(f"{side}_{n}") for n in LABELS[1:]), F.col(f"{side}_{LABELS[0]}")) for side in "gp"}
    rows = F.array(*[F.struct(F.lit(n).alias("label"),
                              F.col(f"p_{n}").alias("product_n"),
                              share(f"p_{n}", total["p"], 100, decimals).alias("product_pct"),
                              F.col(f"g_{n}").alias("global_n"),
                              share(f"g_{n}", total["g"], 100, decimals).alias("global_pct")) for n in LABELS])
    return counts.select(F.inline(rows)).orderBy("label")
