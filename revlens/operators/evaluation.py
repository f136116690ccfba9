"""Prediction quality aggregates.

All metrics derive from one confusion-count aggregate (at most 3 x 3 rows
after the label filter), so the data is scanned once and the metric maths
runs on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS, label_name
from revlens.operators.grids import grid, zero_fill

# Confidence histogram lower edges.
CONF_BINS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
# Product page histogram edges (A23), last edge exclusive.
PRODUCT_BINS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def confusion_counts(df: DataFrame, label_col: str = "true_sentiment",
                     pred_col: str = "prediction") -> DataFrame:
    """A10: rows per (true label, predicted label) as they occur."""
    return (df.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(pred: DataFrame, label_col: str = "true_sentiment",
                     pred_col: str = "prediction") -> DataFrame:
    """Full 3x3 grid in long form (true_label, predicted_label, n), zeros kept.

    Only true labels 0..2 and non-null predictions count; the prediction is
    truncated to an int like the reference. Rows carry class names (T5).
    """
    spark = pred.sparkSession
    t = F.col(label_col).cast("int")
    p = F.col(pred_col).cast("int")
    agg = (pred.filter(F.col(label_col).isin(0, 1, 2) & F.col(pred_col).isNotNull())
           .select(t.alias("t"), p.alias("p"))
           .filter(F.col("p").between(0, 2))
           .groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")))
    axes = grid(spark, t=[0, 1, 2], p=[0, 1, 2])
    out = zero_fill(agg, axes, ["t", "p"], ["n"])
    return out.select(label_name("t").alias("true_label"), label_name("p").alias("predicted_label"), "n")


def _conf_bin(conf: str) -> F.Column:
    """Bin index 0..9; NULL and NaN confidences fall in bin 0."""
    c = F.col(conf)
    usable = c.isNotNull() & ~F.isnan(c)
    b = F.lit(9)
    for i in range(len(CONF_BINS) - 1, 0, -1):
        b = F.when(c < F.lit(CONF_BINS[i]), F.lit(i - 1)).otherwise(b)
    return F.when(usable, b).otherwise(F.lit(0))


def confidence_histogram(pred: DataFrame, conf_col: str = "confidence") -> DataFrame:
    """Label x 10 confidence bins (lower edges 0.50..0.95), zero-filled."""
    spark = pred.sparkSession
    agg = (pred.filter(F.col("sentiment_label").isin(*LABELS))
           .groupBy(F.col("sentiment_label").alias("label"), _conf_bin(conf_col).alias("bin"))
           .agg(F.count(F.lit(1)).alias("n")))
    axes = grid(spark, label=LABELS, bin=list(range(len(CONF_BINS))))
    out = zero_fill(agg, axes, ["label", "bin"], ["n"])
    edges = F.element_at(F.array(*[F.lit(b) for b in CONF_BINS]), F.col("bin").cast("int") + 1)
    return out.select("label", F.col("bin").cast("int").alias("bin"), edges.alias("bin_start"), "n")


def product_confidence_histogram(pred: DataFrame, product_id: str | None = None,
                                 conf_col: str = "confidence") -> DataFrame:
    """Five bins [0.5,0.6) .. [0.9,1.0); NULL counts as 0 so falls outside;
    exactly 1.0 is excluded like the reference page."""
    spark = pred.sparkSession
    df = pred if product_id is None else pred.filter(F.col("ProductId") == product_id)
    c = F.coalesce(F.col(conf_col), F.lit(0.0))
    nb = len(PRODUCT_BINS) - 1
    b = F.lit(None).cast("int")
    for i in range(nb - 1, -1, -1):
        b = F.when((c >= PRODUCT_BINS[i]) & (c < PRODUCT_BINS[i + 1]), F.lit(i)).otherwise(b)
    agg = (df.select(b.alias("bin")).filter(F.col("bin").isNotNull())
           .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    axes = grid(spark, bin=list(range(nb)))
    out = zero_fill(agg, axes, ["bin"], ["n"])
    edges = F.element_at(F.array(*[F.lit(x) for x in PRODUCT_BINS[:-1]]), F.col("bin").cast("int") + 1)
    return out.select(F.col("bin").cast("int").alias("bin"), edges.alias("bin_start"), "n").orderBy("bin")


def _per_class(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """tp, support and predicted count per class 0..2 from the confusion counts."""
    cc = (df.filter(F.col(label_col).isNotNull() & F.col(pred_col).isNotNull())
          .select(F.col(label_col).cast("int").alias("t"), F.col(pred_col).cast("int").alias("p"))
          .filter(F.col("t").between(0, 2) & F.col("p").between(0, 2)))
    # One pass: 9 conditional counts, then unpivot into class rows.
    cells = {(t, p): F.count_if((F.col("t") == t) & (F.col("p") == p)).alias(f"c{t}{p}")
             for t in range(3) for p in range(3)}
    wide = cc.agg(*cells.values(), F.count(F.lit(1)).alias("total"))
    rows = []
    for k in range(3):
        tp = F.col(f"c{k}{k}")
        support = sum((F.col(f"c{k}{p}") for p in range(3)), F.lit(0))
        predicted = sum((F.col(f"c{t}{k}") for t in range(3)), F.lit(0))
        rows.append(F.struct(F.lit(k).alias("cls"), tp.alias("tp"), support.alias("support"),
                             predicted.alias("predicted"), F.col("total").alias("total")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _prf(per: DataFrame) -> DataFrame:
    tp, sup, prd = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    precision = F.when(prd > 0, tp / prd).otherwise(F.lit(0.0))
    recall = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
    per = per.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return per.withColumn("f1", F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)))


def classification_report(df: DataFrame, label_col: str = "true_sentiment",
                          pred_col: str = "prediction", decimals: int = 6) -> DataFrame:
    """Precision, recall, F1, support per class plus macro and weighted rows."""
    per = _prf(_per_class(df, label_col, pred_col))
    classes = per.select(label_name("cls").alias("class"), "precision", "recall", "f1",
                         F.col("support").cast("long").alias("support"))
    w = F.col("support").cast("double")
    summary = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * w) / F.sum(w)).alias("wp"),
        (F.sum(F.col("recall") * w) / F.sum(w)).alias("wr"),
        (F.sum(F.col("f1") * w) / F.sum(w)).alias("wf"),
        F.sum("support").cast("long").alias("n"))
    macro = summary.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    out = classes.unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, decimals).alias(c) for c in ("precision", "recall", "f1")], "support")


def model_metrics(df: DataFrame, label_col: str = "true_sentiment", pred_col: str = "prediction",
                  decimals: int | None = 6) -> DataFrame:
    """A9 (SQL form): accuracy, weighted precision/recall/F1 and macro F1 (T7 names)."""
    per = _prf(_per_class(df, label_col, pred_col))
    w = F.col("support").cast("double")
    tot = F.sum(w)
    agg = per.agg(
        (F.sum("tp") / F.max("total")).alias("accuracy"),
        (F.sum(F.col("precision") * w) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * w) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * w) / tot).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.max("total").cast("long").alias("n"))
    names = ("accuracy", "weighted_precision", "weighted_recall", "f1_weighted", "f1_macro")
    if decimals is None:
        return agg.select(*names, "n")
    return agg.select(*[F.round(c, decimals).alias(c) for c in names], "n")
