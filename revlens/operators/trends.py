"""Time trends over the prediction table (A15, A16, A27, L6/T5s)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS, label_or_neutral
from revlens.functions.timefn import MONTHS, in_year, in_year_raw, normalise_time, usable_time
from revlens.operators.grids import grid, zero_fill

# Heatmap day names, Monday first.
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _label_counts(label_col="sentiment_label", null_as_neutral: bool = True):
    lab = label_or_neutral(label_col) if null_as_neutral else F.col(label_col)
    return [F.count_if(lab == name).alias(name) for name in ("positive", "neutral", "negative")]


def with_review_time(pred: DataFrame) -> DataFrame:
    """Repair millisecond times once (P12) and keep rows with a usable time.

    The raw-range prefilter reaches the scan; the exact check runs on the
    normalised value, so trends and display agree on every row.
    """
    return (pred.filter(usable_time("Time"))
            .withColumn("_t", normalise_time("Time"))
            .filter(F.col("_t").isNotNull()))


def yearly_trend(pred: DataFrame) -> DataFrame:
    """Per UTC year, count of each label; missing label counts as neutral.

    One hash aggregate with conditional counts (partial aggregation before
    the shuffle); the time range prefilter reaches the scan.
    """
    year = F.year(F.timestamp_seconds("_t"))
    return (with_review_time(pred)
            .groupBy(year.alias("y"))
            .agg(*_label_counts())
            .select(F.col("y").cast("string").alias("year"), "positive", "neutral", "negative")
            .orderBy("year"))


def monthly_trend(pred: DataFrame, year: int) -> DataFrame:
    """The 12 months of ``year`` (Jan..Dec, zero-filled) x label counts."""
    spark = pred.sparkSession
    agg = (with_review_time(pred.filter(in_year_raw(year, "Time"))).filter(in_year(year, "_t"))
           .groupBy(F.month(F.timestamp_seconds("_t")).alias("month_num"))
           .agg(*_label_counts()))
    months = grid(spark, month_num=list(range(1, 13)))
    out = zero_fill(agg, months, ["month_num"], ["positive", "neutral", "negative"])
    names = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("month_num").cast("int"))
    return (out.select(F.col("month_num").cast("int").alias("month_num"), names.alias("month"),
                       "positive", "neutral", "negative")
            .orderBy("month_num"))


def activity_heatmap(pred: DataFrame, ts_col: str = "inserted_at") -> DataFrame:
    """Weekday (Mon=0) x hour-of-day counts, total and per label, 7x24 zero-filled."""
    spark = pred.sparkSession
    ts = F.col(ts_col).cast("timestamp")
    agg = (pred.filter(F.col(ts_col).isNotNull())
           .groupBy(F.weekday(ts).alias("day"), F.hour(ts).alias("hour"))
           .agg(F.count(F.lit(1)).alias("count"),
                *[F.count_if(F.col("sentiment_label") == n).alias(n) for n in LABELS]))
    axes = grid(spark, day=list(range(7)), hour=list(range(24)))
    out = zero_fill(agg, axes, ["day", "hour"], ["count"] + LABELS)
    names = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.col("day").cast("int") + 1)
    return out.select(F.col("day").cast("int").alias("day"), names.alias("day_name"),
                      F.col("hour").cast("int").alias("hour"), "count", *LABELS)


def throughput_windows(pred: DataFrame, ts_col: str = "inserted_at",
                       width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """L6 / T5s (batch form): rows per sliding window of ``inserted_at``.

    Same windows as ``F.window(ts, width, slide)``, but the rows are first
    counted per slide-sized bucket (one hash probe per row, partial
    aggregation before the shuffle); only the bucket counts are spread over
    the ``width / slide`` windows that contain them, instead of expanding
    every raw row ``width / slide`` times. The stream form
    (streaming.monitors) keeps ``F.window`` behind a watermark.
    ``rate`` is rows per second over the window width.
    """
    secs, step = _seconds(width), _seconds(slide)
    ts = F.col(ts_col).cast("timestamp")
    if secs % step:
        w = F.window(ts, width, slide)
        out = (pred.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
               .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))
    else:
        us, step_us, width_us = F.unix_micros(ts), step * 1_000_000, secs * 1_000_000
        buckets = (pred.filter(ts.isNotNull())
                   .groupBy((us - F.pmod(us, F.lit(step_us))).alias("_b"))
                   .agg(F.count(F.lit(1)).alias("_n")))
        spread_k = F.explode(F.sequence(F.lit(0), F.lit(secs // step - 1))).alias("_k")
        out = (buckets.select("_b", "_n", spread_k)
               .groupBy((F.col("_b") - F.col("_k") * step_us).alias("_s"))
               .agg(F.sum("_n").alias("n"))
               .select(F.timestamp_micros("_s").alias("window_start"),
                       F.timestamp_micros(F.col("_s") + width_us).alias("window_end"), "n"))
    return out.withColumn("rate", F.round(F.col("n") / F.lit(float(secs)), 2))


def throughput_series(pred: DataFrame, points: int = 60, ts_col: str = "inserted_at",
                      width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """The newest ``points`` values of the sliding throughput (a live chart's history)."""
    w = throughput_windows(pred, ts_col, width, slide)
    return w.orderBy(F.desc("window_start")).limit(points)


def _seconds(text: str) -> int:
    num, unit = text.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}
    return int(num) * mult[unit]
