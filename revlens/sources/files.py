"""File sources and sinks: review CSVs, split files, metadata JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revlens.schemas import MODEL_METADATA, RAW_REVIEW, SPLIT_REVIEW

# NULL is written as \N; a quoted empty field is '' and an unquoted one NULL when read.
NULL_MARK = "\\N"
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "nullValue": NULL_MARK, "emptyValue": ""}
MAX_RECORDS_PER_FILE = 1_000_000   # a multi-line CSV file is read by one task


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw review corpus with a fixed schema (no inference pass)."""
    return spark.read.schema(RAW_REVIEW).options(**CSV_OPTIONS).csv(path)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """A split file written by ``write_splits`` (or the reference's CSVs)."""
    return spark.read.schema(SPLIT_REVIEW).options(**CSV_OPTIONS).csv(path)


# Written values are kept exactly: every field quoted, quotes escaped by
# doubling, and no trimming of leading/trailing spaces (Spark trims by default).
CSV_WRITE_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"',
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                     "nullValue": NULL_MARK, "emptyValue": "", "maxRecordsPerFile": str(MAX_RECORDS_PER_FILE)}


def write_csv(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).options(**CSV_WRITE_OPTIONS)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_splits(split_df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by ``split``; CSV quotes every field."""
    cols = [f.name for f in SPLIT_REVIEW.fields] + ["split"]
    if fmt == "csv":
        write_csv(split_df.select(*cols), path, partition_by="split")
    else:
        split_df.select(*cols).write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        schema = StructType(SPLIT_REVIEW.fields + [StructField("split", StringType(), True)])
        return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return spark.read.parquet(path)


def write_json_record(df: DataFrame, path: str, mode: str = "append") -> None:
    """One-row records (stats, model metadata) as JSON, appended per run."""
    df.coalesce(1).write.mode(mode).json(path)


# Defaults for a model metadata record.
METADATA_DEFAULTS = {"name": "LogReg-TFIDF", "model_type": "LogisticRegression", "f1_score": 0.8274,
                     "accuracy": 0.85, "is_active": True, "notes": ""}


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata file holding one JSON object or a list of them -> one row
    per record, each missing field replaced by its default."""
    raw = spark.read.option("multiLine", True).json(path)
    cols = set(raw.columns)

    def pick(name, cast):
        return F.col(name).cast(cast) if name in cols else F.lit(None).cast(cast)

    d = METADATA_DEFAULTS
    return raw.select(
        F.coalesce(pick("name", "string"), F.lit(d["name"])).alias("name"),
        F.coalesce(pick("model_type", "string"), F.lit(d["model_type"])).alias("model_type"),
        F.coalesce(pick("f1_score", "double"), F.lit(d["f1_score"])).alias("f1_score"),
        F.coalesce(pick("accuracy", "double"), F.lit(d["accuracy"])).alias("accuracy"),
        F.coalesce(pick("is_active", "boolean"), F.lit(d["is_active"])).alias("is_active"),
        F.coalesce(pick("notes", "string"), F.lit(d["notes"])).alias("notes"),
        F.coalesce(F.try_to_timestamp(pick("trained_at", "string")), F.current_timestamp()).alias("trained_at"))


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S13 reader in the fixed metadata schema."""
    return spark.read.schema(MODEL_METADATA).option("multiLine", True).json(path)
