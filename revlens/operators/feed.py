"""Row feeds, filters and the display format of a prediction."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.timefn import display_date, iso_timestamp


def by_sentiment(df: DataFrame, sentiment: str | None) -> DataFrame:
    """Equality filter unless the value is None, '' or 'all'."""
    if sentiment and sentiment != "all":
        return df.filter(F.col("sentiment_label") == sentiment)
    return df


def by_product(df: DataFrame, product_id: str) -> DataFrame:
    """P14."""
    return df.filter(F.col("ProductId") == product_id)


def by_sentiments(df: DataFrame, labels: list[str]) -> DataFrame:
    """Membership filter."""
    return df.filter(F.col("sentiment_label").isin(*labels))


def text_preview(col="Text", n: int = 100) -> Column:
    """First n characters, with an ellipsis when the text is longer."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def _label_fallback() -> Column:
    """Stored label, else the name of the numeric code (missing code = 0)."""
    lab = F.col("sentiment_label")
    code = F.coalesce(F.col("prediction").cast("double"), F.lit(0.0)).cast("int")
    from_code = (F.when(code == 0, F.lit("negative")).when(code == 1, F.lit("neutral"))
                 .when(code == 2, F.lit("positive")).otherwise(F.lit("neutral")))
    return F.when(lab.isNull() | (lab == ""), from_code).otherwise(lab)


def format_prediction(df: DataFrame) -> DataFrame:
    """P11 + P12 + P20: the display record of a stored prediction; its id is ``Id``, or
    the store's ``_id`` where ``Id`` is missing, NULL or 0."""
    own = F.col("Id").cast("string")
    if "_id" in df.columns:
        own = F.coalesce(F.when(F.col("Id") != 0, own), F.col("_id").cast("string"))
    return df.select(
        own.alias("id"),
        F.coalesce(F.col("ProductId"), F.lit("")).alias("productId"),
        F.coalesce(F.col("UserId"), F.lit("")).alias("userId"),
        F.coalesce(F.col("Summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("Text"), F.lit("")).alias("text"),
        display_date("Time").alias("time"),
        _label_fallback().alias("sentiment"),
        F.col("confidence").try_cast("double").alias("confidence"),
        F.col("true_sentiment").alias("trueSentiment"),
        F.col("prediction").alias("prediction"),
    )


def serialise(df: DataFrame, id_cols: tuple[str, ...] = ("Id", "_id")) -> DataFrame:
    """P20: JSON-safe values -- id columns as text, timestamps as ISO-8601 text."""
    cols = []
    for name, dtype in df.dtypes:
        if name in id_cols:
            cols.append(F.col(name).cast("string").alias(name))
        elif dtype.startswith("timestamp"):
            cols.append(iso_timestamp(name).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def newest_cutoff(df: DataFrame, k: int, ts_col: str = "inserted_at") -> Column | None:
    """The k-th newest non-null ``ts_col`` value (ties count) as a literal, or None
    when fewer than k rows have one. Reads only that column: each task keeps its
    own k newest values, and one number comes back to the driver. Timestamps
    travel as epoch microseconds (no time-zone conversion on the driver);
    numeric times as they are."""
    is_ts = dict(df.dtypes)[ts_col].startswith("timestamp")
    c = F.col(ts_col).cast("timestamp") if is_ts else F.col(ts_col)
    value = F.unix_micros(F.min("_v")) if is_ts else F.min("_v")
    row = (df.select(c.alias("_v")).where(F.col("_v").isNotNull())
           .orderBy(F.desc("_v")).limit(k)
           .agg(F.count(F.lit(1)).alias("n"), value.alias("v")).first())
    if row is None or row["n"] < k:
        return None
    return F.timestamp_micros(F.lit(int(row["v"]))) if is_ts else F.lit(row["v"])


def newest_rows(df: DataFrame, k: int, ts_col: str = "inserted_at", key_col: str = "Id",
                offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + k`` by ``ts_col`` newest first (NULL last,
    ``key_col`` breaks ties, T12).

    Two steps, so wide columns (review texts) are not read for every row:
    ``newest_cutoff`` finds the (offset + k)-th newest time from the time
    column alone; the rows at or after it -- a literal range on the stored
    column, pushed into the Parquet scan, so older row groups are skipped --
    are then sorted and cut (TakeOrderedAndProject). Exact: at least
    offset + k rows pass the cutoff, and every row of the page does; NULL
    times can only be on the page when fewer rows have a time, and then
    nothing is filtered.
    """
    cutoff = newest_cutoff(df, offset + k, ts_col)
    if cutoff is not None:
        c = F.col(ts_col).cast("timestamp") if dict(df.dtypes)[ts_col].startswith("timestamp") else F.col(ts_col)
        df = df.filter(c >= cutoff)
    ordered = df.orderBy(F.desc_nulls_last(ts_col), F.desc(key_col))
    return (ordered.offset(offset) if offset else ordered).limit(k)


def recent(pred: DataFrame, limit: int = 50, sentiment: str | None = None) -> DataFrame:
    """Newest ``limit`` rows by inserted_at (Id breaks ties, T12), see
    ``newest_rows``."""
    return newest_rows(by_sentiment(pred, sentiment), limit)


def after_cursor(pred: DataFrame, cursor: int | None, limit: int = 20,
                 newest_first: bool = False) -> DataFrame:
    """L2: rows with Id > cursor. Oldest first by default so a tail never skips rows
    (T13); ``newest_first`` keeps the reference order.

    Oldest first, the ``limit``-th id after the cursor is found from the Id
    column alone (per-task top-k, one number to the driver); whole rows are
    then read only for ids in (cursor, that id] -- literal ranges pushed into
    the Parquet scan -- so a reader far behind does not read every text after
    its cursor.
    """
    df = pred if cursor is None else pred.filter(F.col("Id") > F.lit(cursor))
    if newest_first:
        return newest_rows(df, limit, "Id")
    row = (df.select("Id").where(F.col("Id").isNotNull()).orderBy("Id").limit(limit)
           .agg(F.count(F.lit(1)).alias("n"), F.max("Id").alias("last")).first())
    if row is not None and row["n"] >= limit:
        # NULL ids sort first in ascending order, so they stay (only without a cursor).
        df = df.filter(F.col("Id").isNull() | (F.col("Id") <= F.lit(int(row["last"]))))
    return df.orderBy(F.asc("Id")).limit(limit)


def latest(pred: DataFrame) -> DataFrame:
    """The row with the newest inserted_at (ties: highest Id)."""
    return recent(pred, 1)


def _safe_pattern(spark, q: str) -> str:
    """A pattern that Spark's (Java) regex engine cannot compile is searched
    as a literal. The check runs in Spark's own dialect on one literal row, so
    a Python-only construct such as ``(?P<name>...)`` is caught as well."""
    try:
        spark.range(1).select(F.lit("").rlike("(?iu)" + q)).collect()
        return q
    except PySparkException as e:
        if "PATTERN" not in f"{e.getCondition()} {e}".upper():
            raise  # not about the pattern
        return re.escape(q)


def search(df: DataFrame, q: str | None, limit: int = 20, literal: bool = False) -> DataFrame:
    """Case-insensitive match on Summary or Text; empty query returns nothing.

    Rows come back in Id order so the 20 returned are deterministic.
    """
    if not q:
        return df.limit(0)
    if literal:
        needle = F.lit(q.lower())
        hit = (F.lower(F.coalesce("Summary", F.lit(""))).contains(needle)
               | F.lower(F.coalesce("Text", F.lit(""))).contains(needle))
    else:
        pat = "(?iu)" + _safe_pattern(df.sparkSession, q)
        hit = (F.coalesce(F.col("Summary").rlike(pat), F.lit(False))
               | F.coalesce(F.col("Text").rlike(pat), F.lit(False)))
    return df.filter(hit).orderBy("Id").limit(limit)
