"""Fixed schemas of every record the engine reads or writes (no inference)."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


RAW_REVIEW = _s(
    ("Id", LongType()), ("ProductId", StringType()), ("UserId", StringType()),
    ("ProfileName", StringType()), ("HelpfulnessNumerator", IntegerType()),
    ("HelpfulnessDenominator", IntegerType()), ("Score", IntegerType()),
    ("Time", LongType()), ("Summary", StringType()), ("Text", StringType()),
)

# Columns kept after cleaning and in the split files.
CLEAN_REVIEW = _s(
    ("Id", LongType()), ("ProductId", StringType()), ("UserId", StringType()),
    ("Time", LongType()), ("Summary", StringType()), ("Text", StringType()),
    ("cleaned", StringType()), ("Score", IntegerType()), ("sentiment", IntegerType()),
)

SPLIT_REVIEW = _s(
    ("Id", LongType()), ("ProductId", StringType()), ("UserId", StringType()),
    ("Time", LongType()), ("Summary", StringType()), ("Text", StringType()),
    ("cleaned", StringType()), ("sentiment", IntegerType()),
)

# JSON value of an incoming stream message.
STREAM_REVIEW = _s(
    ("Id", LongType()), ("ProductId", StringType()), ("UserId", StringType()),
    ("Time", LongType()), ("Summary", StringType()), ("Text", StringType()),
    ("cleaned", StringType()), ("true_sentiment", IntegerType()),
)

PREDICTION = StructType(STREAM_REVIEW.fields + [
    StructField("prediction", DoubleType(), True),
    StructField("sentiment_label", StringType(), True),
    StructField("confidence", DoubleType(), True),
    StructField("inserted_at", TimestampType(), True),
])

LIVE_RECORD = _s(
    ("id", LongType()), ("productId", StringType()), ("summary", StringType()),
    ("sentiment", StringType()), ("confidence", DoubleType()), ("time", LongType()),
)

MODEL_METADATA = _s(
    ("model_type", StringType()), ("f1_val", DoubleType()), ("f1_lr", DoubleType()),
    ("f1_nb", DoubleType()), ("trained_on", StringType()), ("num_features", IntegerType()),
    ("train_size", LongType()), ("balanced_size", LongType()), ("f1_test", DoubleType()),
    ("acc_test", DoubleType()), ("precision_test", DoubleType()), ("recall_test", DoubleType()),
)

PREPROCESSING_STATS = StructType([
    StructField("total", LongType()), StructField("train", LongType()),
    StructField("val", LongType()), StructField("test", LongType()),
    StructField("classes", _s(("negative", LongType()), ("neutral", LongType()),
                              ("positive", LongType()))),
    StructField("avg_cleaned_len", DoubleType()),
])

CHECK_RESULT = _s(
    ("check", StringType()), ("status", StringType()), ("value", DoubleType()),
    ("threshold", DoubleType()), ("detail", StringType()),
)

LEMMA = _s(("form", StringType()), ("lemma", StringType()))

OFFSET_SNAPSHOT = _s(("run_time", TimestampType()), ("topic", StringType()), ("total", LongType()))
