"""Data-quality checks over the prediction table and its inputs (Q1-Q8).

Each check returns rows of (check, status, value, threshold, detail) with
status ok / skip / fail. ``now`` is always a parameter (a column or a
literal); it defaults to the clock. A literal gives the same answer when re-run.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.labels import LABELS

# Thresholds of the checks.
FRESH_WINDOW_S = 120
QUALITY_SAMPLE = 50
MAX_UNLABELLED = 10
MIN_MEAN_CONFIDENCE = 0.5
MAX_LAG_S = 60
MIN_ROWS_FOR_BALANCE = 100
MAX_POSITIVE_PCT = 95.0
MAX_NEGATIVE_PCT = 60.0

ORDER = {"inputs_exist": 1, "source_traffic": 2, "live_traffic": 3, "stats_freshness": 4,
         "prediction_labels": 5, "prediction_confidence": 5, "pipeline_latency": 6, "sentiment_balance": 7}


def _row(check: str, status: Column, value: Column, threshold: float | None, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), status.alias("status"), value.cast("double").alias("value"),
            F.lit(threshold).cast("double").alias("threshold"), detail.alias("detail")]


def _result(check: str, status: Column, value: Column, threshold: float | None, detail: Column) -> Column:
    """A check's row as a struct, for one aggregate that answers several checks."""
    return F.struct(*_row(check, status, value, threshold, detail))


def _now(now) -> Column:
    if isinstance(now, Column):
        return now.cast("timestamp")
    if isinstance(now, _dt.datetime):
        return F.lit(now).cast("timestamp")
    return F.lit(now).cast("timestamp")


def with_now(pred: DataFrame, now=None) -> DataFrame:
    """Attach ``_now``: the given time, or the clock. Never a time taken from the
    checked table: measured against its own newest row no table is ever late."""
    return pred.withColumn("_now", F.current_timestamp() if now is None else _now(now))


def inputs_exist(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Q1: every named input path exists, else skip (pipeline not started)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for name, p in paths.items():
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if not hp.getFileSystem(conf).exists(hp):
            missing.append(name)
    status = "skip" if missing else "ok"
    detail = ("missing: " + ", ".join(sorted(missing))) if missing else "all inputs present"
    return spark.createDataFrame([("inputs_exist", status, float(len(missing)), 0.0, detail)],
                                 "check string, status string, value double, threshold double, detail string")


def traffic(snapshots: DataFrame, check: str = "source_traffic") -> DataFrame:
    """Q2 / Q3: per run, offset growth since the previous run of the same topic.

    total 0 -> skip; first run -> ok (reference recorded); no growth -> fail.
    The window runs over the snapshot table (one row per run and topic).
    """
    w = Window.partitionBy("topic").orderBy("run_time")
    s = snapshots.withColumn("prev", F.lag("total").over(w))
    delta = F.col("total") - F.col("prev")
    status = (F.when(F.col("total") == 0, F.lit("skip"))
              .when(F.col("prev").isNull(), F.lit("ok"))
              .when(delta == 0, F.lit("fail")).otherwise(F.lit("ok")))
    detail = (F.when(F.col("total") == 0, F.lit("topic empty"))
              .when(F.col("prev").isNull(), F.concat(F.lit("first run, offset "), F.col("total").cast("string")))
              .otherwise(F.concat(F.lit("+"), delta.cast("string"), F.lit(" messages, offset "),
                                  F.col("total").cast("string"))))
    return s.select("run_time", "topic", *_row(check, status, F.coalesce(delta, F.lit(0)), 0.0, detail))


def _freshness_parts() -> list[Column]:
    recent = F.count_if(F.col("inserted_at").cast("timestamp")
                        >= F.col("_now") - F.expr(f"INTERVAL {FRESH_WINDOW_S} SECONDS"))
    return [F.count(F.lit(1)).alias("total"), recent.alias("recent")]


def _freshness_result() -> Column:
    status = (F.when(F.col("total") == 0, F.lit("skip")).when(F.col("recent") == 0, F.lit("fail"))
              .otherwise(F.lit("ok")))
    detail = F.concat(F.lit("+"), F.col("recent").cast("string"), F.lit(" rows/2min, total "),
                      F.col("total").cast("string"))
    return _result("stats_freshness", status, F.col("recent") / F.lit(float(FRESH_WINDOW_S)), 0.0, detail)


def freshness(pred: DataFrame, now=None) -> DataFrame:
    """Q4: rows inserted in the last two minutes; value = rows per second over the window."""
    return with_now(pred, now).agg(*_freshness_parts()).select(F.inline(F.array(_freshness_result())))


def prediction_quality(pred: DataFrame) -> DataFrame:
    """Q5: over the newest 50 rows, unlabelled count (> 10 fails) and mean
    confidence with missing as 0 (< 0.5 fails); NULL confidences are reported."""
    from revlens.operators.feed import newest_rows
    newest = newest_rows(pred, QUALITY_SAMPLE)
    lab = F.col("sentiment_label")
    agg = newest.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(lab.isNull() | (lab == "")).alias("unlabelled"),
                     F.avg(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("mean_conf"),
                     F.count_if(F.col("confidence").isNull()).alias("null_conf"))
    empty = F.col("n") == 0
    s1 = F.when(empty, F.lit("skip")).when(F.col("unlabelled") > MAX_UNLABELLED, F.lit("fail")).otherwise(F.lit("ok"))
    s2 = (F.when(empty, F.lit("skip")).when(F.col("mean_conf") < MIN_MEAN_CONFIDENCE, F.lit("fail"))
          .otherwise(F.lit("ok")))
    d1 = F.concat(F.col("unlabelled").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" unlabelled"))
    d2 = F.concat(F.lit("mean confidence over "), F.col("n").cast("string"), F.lit(" rows, "),
                  F.col("null_conf").cast("string"), F.lit(" without confidence"))
    both = F.array(_result("prediction_labels", s1, F.col("unlabelled"), float(MAX_UNLABELLED), d1),
                   _result("prediction_confidence", s2, F.round("mean_conf", 6), MIN_MEAN_CONFIDENCE, d2))
    return agg.select(F.inline(both))


def _latency_parts() -> list[Column]:
    return [F.max(F.col("inserted_at").cast("timestamp")).alias("last"), F.max("_now").alias("now")]


def _latency_result() -> Column:
    lag = (F.unix_micros("now") - F.unix_micros("last")) / F.lit(1e6)
    status = (F.when(F.col("last").isNull(), F.lit("skip")).when(lag > MAX_LAG_S, F.lit("fail"))
              .otherwise(F.lit("ok")))
    detail = F.coalesce(F.concat(F.lit("lag "), F.round(lag, 0).cast("long").cast("string"), F.lit(" s")),
                        F.lit("no rows"))
    return _result("pipeline_latency", status, lag, float(MAX_LAG_S), detail)


def latency(pred: DataFrame, now=None) -> DataFrame:
    """Q6: seconds from the newest inserted_at to ``now``; above 60 fails, empty skips."""
    return with_now(pred, now).agg(*_latency_parts()).select(F.inline(F.array(_latency_result())))


def _balance_parts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("sentiment_label") == n).alias(n) for n in LABELS]]


def _balance_result() -> Column:
    pos = F.try_divide(F.col("positive").cast("double") * 100.0, F.col("total"))
    neg = F.try_divide(F.col("negative").cast("double") * 100.0, F.col("total"))
    status = (F.when(F.col("total") < MIN_ROWS_FOR_BALANCE, F.lit("skip"))
              .when(pos > MAX_POSITIVE_PCT, F.lit("fail"))
              .when(neg > MAX_NEGATIVE_PCT, F.lit("fail")).otherwise(F.lit("ok")))
    detail = F.concat(F.lit("positive "), F.col("positive").cast("string"), F.lit(", negative "),
                      F.col("negative").cast("string"), F.lit(", total "), F.col("total").cast("string"))
    return _result("sentiment_balance", status, F.round(pos, 6), MAX_POSITIVE_PCT, detail)


def balance(pred: DataFrame) -> DataFrame:
    """Q7: fewer than 100 rows -> skip; positive share > 95 % or negative > 60 % -> fail.

    Shares are of all rows (unknown labels included in the total, like the reference)."""
    return pred.agg(*_balance_parts()).select(F.inline(F.array(_balance_result())))


def table_checks(pred: DataFrame, now=None) -> DataFrame:
    """Q4, Q6 and Q7 from one scan and one aggregate of the prediction table."""
    parts = _freshness_parts() + _latency_parts() + _balance_parts()[1:]
    results = F.array(_freshness_result(), _latency_result(), _balance_result())
    return with_now(pred, now).agg(*parts).select(F.inline(results))


def report(*checks: DataFrame) -> DataFrame:
    """Q8: the checks in order 1 -> 2 -> {3, 4} -> 5 -> 6 -> 7; after a failure the
    later checks are reported as skip (they would not run)."""
    cols = ["check", "status", "value", "threshold", "detail"]
    allc = checks[0].select(*cols)
    for c in checks[1:]:
        allc = allc.unionByName(c.select(*cols))
    order = F.element_at(F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))]), F.col("check"))
    allc = allc.withColumn("step", order)
    first_fail = allc.agg(F.min(F.when(F.col("status") == "fail", F.col("step")))).scalar()
    return (allc.withColumn("_ff", first_fail)
            .withColumn("status", F.when(F.col("_ff").isNotNull() & (F.col("step") > F.col("_ff")), F.lit("skip"))
                        .otherwise(F.col("status")))
            .drop("_ff").orderBy("step", "check"))


def event_snapshots(events: DataFrame, every_minutes: int = 5, topic: str = "events",
                    ts_col: str = "ts") -> DataFrame:
    """Offset snapshots derived from an event table: at the end of every run
    interval, the cumulative number of events so far (a stand-in for topic
    offsets). Intervals without events appear with an unchanged total.

    The running total is a two-level prefix sum: a running sum inside each
    day (windows partitioned by day) plus the total of all earlier days (a
    window over one row per day). No window ever holds more than one day of
    run intervals or the list of days. The interval axis is ``spark.range``
    between the first and last interval (two numbers read first): its rows are made
    by many tasks, so one event with a far-off year makes a long axis but no
    large array or task. Events without a time are in no interval; a table without
    any gives no snapshots.
    """
    step = every_minutes * 60
    t = F.unix_seconds(F.col(ts_col).cast("timestamp"))
    run_end = (F.floor(t / step) + 1) * step
    lo, hi = events.agg(F.min(run_end), F.max(run_end)).first()
    runs = events.sparkSession.range(lo or 0, hi + step if hi is not None else 0, step).withColumnRenamed("id", "run_s")
    per = events.filter(F.col(ts_col).isNotNull()).groupBy(run_end.alias("run_s")).agg(F.count(F.lit(1)).alias("n"))
    grid = (runs.join(per, "run_s", "left").fillna(0, subset=["n"])
            .withColumn("day", F.floor((F.col("run_s") - 1) / 86400)))
    in_day = Window.partitionBy("day").orderBy("run_s").rowsBetween(Window.unboundedPreceding, 0)
    days = grid.groupBy("day").agg(F.sum("n").alias("day_n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("day", F.coalesce(F.sum("day_n").over(before), F.lit(0)).alias("offset"))
    return (grid.withColumn("in_day", F.sum("n").over(in_day))
            .join(offsets, "day")
            .select(F.timestamp_seconds("run_s").alias("run_time"), F.lit(topic).alias("topic"),
                    (F.col("offset") + F.col("in_day")).cast("long").alias("total")))
