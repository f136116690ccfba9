"""Corpus profiling and split checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.mathfn import share
from revlens.functions.text import text_length


def null_profile(df: DataFrame) -> DataFrame:
    """A3: one row per column: position, name, type, null count, row count.

    All null counts come from a single aggregate over the table.
    """
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"_n{i}").alias("nulls"), F.col("_rows").alias("rows"))
            for i, c in enumerate(cols)]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def text_length_stats(df: DataFrame, decimals: int = 6) -> DataFrame:
    """A4: mean character length of Text and Summary (NULL as '') and Summary nulls."""
    return df.agg(
        F.round(F.avg(text_length("Text")), decimals).alias("avg_text_len"),
        F.round(F.avg(text_length("Summary")), decimals).alias("avg_summary_len"),
        F.count_if(F.col("Summary").isNull()).alias("summary_nulls"),
        F.count(F.lit(1)).alias("rows"))


def preprocessing_stats(split_df: DataFrame, decimals: int = 6) -> DataFrame:
    """A5: totals per split and class, mean cleaned length, empty cleaned count -- one pass."""
    s, y = F.col("split"), F.col("sentiment")
    return split_df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "train").alias("train"), F.count_if(s == "val").alias("val"),
        F.count_if(s == "test").alias("test"),
        F.count_if(y == 0).alias("negative"), F.count_if(y == 1).alias("neutral"),
        F.count_if(y == 2).alias("positive"),
        F.round(F.avg(text_length("cleaned")), decimals).alias("avg_cleaned_len"),
        F.count_if(F.coalesce(F.col("cleaned"), F.lit("")) == "").alias("empty_cleaned"))


def stats_record(stats: DataFrame) -> DataFrame:
    """S12 shape: nested ``classes`` struct as in the preprocessing stats file."""
    return stats.select("total", "train", "val", "test",
                        F.struct("negative", "neutral", "positive").alias("classes"),
                        "avg_cleaned_len")


def split_report(split_df: DataFrame, decimals: int = 1) -> DataFrame:
    """Rows per (split, class) with the class share inside its split and the split share."""
    agg = split_df.groupBy("split", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    in_split = F.sum("n").over(Window.partitionBy("split"))   # aggregated rows: splits x classes
    overall = agg.agg(F.sum("n")).scalar()
    return (agg.withColumn("split_rows", in_split).withColumn("_total", overall)
            .withColumn("pct_of_split", share("n", "split_rows", 100, decimals))
            .withColumn("split_pct", share("split_rows", "_total", 100, decimals)).drop("_total")
            .orderBy("split", "sentiment"))


def split_verify(split_df: DataFrame) -> DataFrame:
    """Per split: rows, the distinct labels (sorted, as text) and label nulls."""
    labels = F.array_join(F.array_sort(F.collect_set(F.col("sentiment").cast("string"))), ",")
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), labels.alias("labels"),
        F.count_if(F.col("sentiment").isNull()).alias("label_nulls"))
