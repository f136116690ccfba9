"""Training-set preparation.

Sampling and splitting use a seeded hash of the review Id instead of a
per-partition random generator: the chosen rows do not depend on how the
data is partitioned, a recomputed task after a lost executor picks the
same rows, and no shuffle is needed at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.hashing import unit_hash
from revlens.functions.labels import NEGATIVE, NEUTRAL, POSITIVE, label_name
from revlens.functions.text import clean_text, full_text

TRAIN, VAL, TEST = "train", "val", "test"


def cast_label(df: DataFrame, col: str = "sentiment") -> DataFrame:
    """Label to int; text that is not a number becomes NULL."""
    return df.withColumn(col, F.col(col).try_cast("int"))


def drop_unusable(df: DataFrame) -> DataFrame:
    """Cleaned text present and non-empty, label present."""
    return (df.filter(F.col("cleaned").isNotNull() & (F.col("cleaned") != "") & F.col("sentiment").isNotNull())
            .withColumn("cleaned", F.coalesce("cleaned", F.lit(""))))


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Raw reviews -> cleaned table: label from Score (P1), cleaned full text."""
    from revlens.functions.labels import score_to_label
    return raw.select("Id", "ProductId", "UserId", "Time", "Summary", "Text",
                      clean_text(full_text()).alias("cleaned"),
                      F.col("Score").cast("int").alias("Score"),
                      score_to_label("Score").alias("sentiment"))


def stratified_split(df: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42,
                     key_col: str = "Id") -> DataFrame:
    """Add ``split`` = train/val/test (80/10/10 by default).

    Each row draws one seeded hash value; the thresholds are the same for
    every class, so each class is split in the same proportions (T15:
    shares hold in expectation, splits are disjoint and complete). A pure
    projection: no shuffle, no window.
    """
    u = unit_hash(key_col, seed)
    split = F.when(u < train, F.lit(TRAIN)).when(u < train + val, F.lit(VAL)).otherwise(F.lit(TEST))
    return df.withColumn("split", split)


MAX_CLASSES = 1000


def stratified_split_exact(df: DataFrame, train_pct: int = 80, val_pct: int = 10, seed: int = 42,
                           key_col: str = "Id", label_col: str = "sentiment", buckets: int = 4096) -> DataFrame:
    """L9 with exact per-class sizes: in every class of n rows, ordered by the
    seeded hash, the first n - ceil(n * (100 - train_pct) / 100) rows are train;
    of the rest, ceil(rest * test_pct / (val_pct + test_pct)) are test and the
    others val (the split sizes of a two-step 80/20 then 50/50 split).

    No class is ranked as a whole (one may hold most rows), and nothing
    depends on how rows are partitioned:
    1. rows are counted per (class, hash bucket); only key and label are read;
    2. running totals of the counts name the bucket in which each class passes
       from train to val and from val to test (one row per class on the driver);
    3. every other bucket lies on one side: its rows are assigned by comparison,
       in place; only rows of the (at most two) boundary buckets are ranked.
    """
    test_pct = 100 - train_pct - val_pct
    marked = (df.withColumn("_u", unit_hash(key_col, seed))
              .withColumn("_b", F.floor(F.col("_u") * buckets).cast("int")))
    counts = marked.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("_n").over(Window.partitionBy(label_col))
    rest = idiv_ceil(n * (100 - train_pct), 100)
    test = idiv_ceil(rest * test_pct, val_pct + test_pct)
    totals = counts.select(label_col, "_b", "_n", F.sum("_n").over(upto).alias("_upto"),
                           (n - rest).alias("_val_from"), (n - test).alias("_test_from"))
    passes = lambda at: F.min(F.when(F.col("_upto") > F.col(at), F.struct("_b", (F.col("_upto") - F.col("_n")).alias("o"))))
    edges = (totals.groupBy(label_col).agg(F.first("_val_from").alias("v"), F.first("_test_from").alias("t"),
                                           passes("_val_from").alias("bv"), passes("_test_from").alias("bt"))
             .limit(MAX_CLASSES + 1).collect())
    if len(edges) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label_col}")
    bucket, at = F.col("_b"), F.col("_rank")
    sure, ranked, offset, on_edge = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), F.lit(False)
    for r in edges:
        own = F.col(label_col).eqNullSafe(F.lit(r[label_col]))
        bv, bt = (e["_b"] if e else buckets for e in (r["bv"], r["bt"]))
        mixed = (bucket == bv) | (bucket == bt)
        on_edge = on_edge | (own & mixed)
        sure = F.when(own & ~mixed, F.when(bucket < bv, F.lit(TRAIN)).when(bucket < bt, F.lit(VAL))
                      .otherwise(F.lit(TEST))).otherwise(sure)
        ranked = F.when(own, F.when(at < r["v"], F.lit(TRAIN)).when(at < r["t"], F.lit(VAL))
                        .otherwise(F.lit(TEST))).otherwise(ranked)
        for e in (r["bv"], r["bt"]):
            if e:
                offset = F.when(own & (bucket == e["_b"]), F.lit(e["o"])).otherwise(offset)
    inside = Window.partitionBy(label_col, "_b").orderBy("_u", key_col)
    last = (marked.filter(on_edge).withColumn("_rank", offset + F.row_number().over(inside) - 1)
            .withColumn("split", ranked).drop("_rank"))
    return marked.filter(~on_edge).withColumn("split", sure).unionByName(last).drop("_u", "_b")


def idiv_ceil(a, b):
    """ceil(a / b) for non-negative longs, exact."""
    from revlens.functions.mathfn import idiv
    return idiv(a + F.lit(b - 1), F.lit(b))


def class_counts(df: DataFrame, label_col: str = "sentiment") -> dict:
    """Rows per class, brought to the driver (at most one row per class)."""
    return {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}


def undersample_fraction(counts: dict, ratio: float = 3.0) -> float:
    """Fraction of positives kept so positives are ``ratio`` x neutrals, capped at 1."""
    pos, neu = counts.get(POSITIVE, 0), counts.get(NEUTRAL, 0)
    return 1.0 if pos == 0 else min(ratio * neu / pos, 1.0)


def undersample_majority(df: DataFrame, fraction: float | None = None, ratio: float = 3.0,
                         seed: int = 42, key_col: str = "Id") -> DataFrame:
    """L8 + U1: keep all negatives and neutrals and a seeded ``fraction`` of positives.

    One filter over the table instead of three filtered copies and a union.
    """
    if fraction is None:
        fraction = undersample_fraction(class_counts(df), ratio)
    u = unit_hash(key_col, seed, "undersample")
    keep = (F.col("sentiment") != POSITIVE) | (u < F.lit(float(fraction)))
    return df.filter(F.col("sentiment").isNotNull() & keep)


def class_weights(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Weight per class = total / (3 * count of the class) over labels 0..2."""
    agg = (df.filter(F.col(label_col).isin(NEGATIVE, NEUTRAL, POSITIVE))
           .groupBy(F.col(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("n")))
    total = agg.agg(F.sum("n")).scalar()  # over at most 3 aggregated rows
    return agg.select(label_col, "n", (total.cast("double") / (F.lit(3.0) * F.col("n"))).alias("classWeight"))


def with_class_weight(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Attach classWeight by joining the (at most 3-row) weight table.

    Filtering happens before the weights are computed (T10). The weight
    table has one row per class value 0..2, a proven broadcast bound.
    """
    df = df.filter(F.col(label_col).isin(NEGATIVE, NEUTRAL, POSITIVE))
    w = class_weights(df, label_col).select(label_col, "classWeight")
    return df.join(F.broadcast(w), label_col)


def examples_per_class(df: DataFrame, k: int = 2, seed: int = 42, label_col: str = "sentiment",
                       key_col: str = "Id") -> DataFrame:
    """K pseudo-random example rows per class (hash order).

    ``row_number() <= k`` is planned with a partial WindowGroupLimit, so
    each task forwards only k rows per class to the shuffle.
    """
    u = unit_hash(key_col, seed, "example")
    rn = F.row_number().over(Window.partitionBy(label_col).orderBy(u, F.col(key_col)))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).withColumnRenamed("_rn", "example")


def true_label(col: str = "sentiment"):
    """P5 for the true label."""
    return label_name(col)
