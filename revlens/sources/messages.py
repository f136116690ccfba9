"""Review messages: Kafka source/sink and a file stand-in with the same shape.

A message is (key string, value string) where the value is the JSON of a
review. The Kafka connector jar is not bundled with PySpark; the Kafka
functions here only set options and fail with a clear message when the
connector is missing. ``message_files_*`` give the same (key, value)
shape on a folder of JSON-lines files, used by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revlens.schemas import LIVE_RECORD, STREAM_REVIEW

MESSAGE_SCHEMA = "key string, value string"
# Topic names.
REVIEWS_TOPIC = "amazon-reviews"
LIVE_TOPIC = "predictions-live"


class ConnectorMissing(RuntimeError):
    pass


def _kafka_guard(fn):
    def run(*a, **kw):
        try:
            return fn(*a, **kw)
        except Exception as e:  # noqa: BLE001 - the JVM raises a generic AnalysisException
            if "kafka" in str(e).lower() and ("not find" in str(e).lower() or "failed to find" in str(e).lower()):
                raise ConnectorMissing("Kafka connector (spark-sql-kafka) is not on the classpath") from e
            raise
    return run


@_kafka_guard
def kafka_source(spark: SparkSession, servers: str, topic: str = REVIEWS_TOPIC,
                 starting_offsets: str = "latest", fail_on_data_loss: bool = False,
                 max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S3: subscribe to ``topic``; yields Kafka's key/value binary columns.

    ``max_offsets_per_trigger`` bounds a micro-batch, so a backlog is worked
    off in batches of known size instead of one batch of everything.
    """
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic)
         .option("startingOffsets", starting_offsets)
         .option("failOnDataLoss", str(fail_on_data_loss).lower()))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", int(max_offsets_per_trigger))
    return r.load()


def message_files_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S3 stand-in: a streaming folder of JSON-lines messages {key, value}."""
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


# Why a message is not a review.
NO_VALUE, NOT_JSON, WRONG_TYPE, NO_ID = "no value", "not json", "wrong type", "no id"


def decode(raw: DataFrame) -> DataFrame:
    """Message value (bytes or text) -> ``review`` by a fixed schema, ``reason`` (NULL for a review) and the value as text.

    A message is rejected whole: one of its fields with another type than the schema's, a value that is no
    JSON object, no value at all, or a review without an id.
    """
    text = F.col("value").cast("string")
    schema = StructType(STREAM_REVIEW.fields + [StructField("_corrupt", StringType(), True)])
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Spark's parser ignores what follows a value; as the first of two elements the text must end where its value does.
    whole = F.get_json_object(F.concat(F.lit("["), text, F.lit(',"end of message"]')), "$[1]") == "end of message"
    read = F.struct(F.col("key").cast("string").alias("key"), text.alias("value"), whole.alias("whole"), parsed.alias("d"))
    # Exploded from an array of one, a message is read once: else a filter on the reason is pushed below and
    # parses (and makes) it again for every field it asks.
    rows = raw.select(F.inline(F.array(read)))
    reason = (F.when(F.col("value").isNull() | (F.trim("value") == ""), F.lit(NO_VALUE))
              .when(~F.coalesce("whole", F.lit(False)), F.lit(NOT_JSON))
              .when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), F.lit(WRONG_TYPE))
              .when(F.col("d.Id").isNull(), F.lit(NO_ID)))
    review = F.struct(*[F.col(f"d.{f.name}").alias(f.name) for f in STREAM_REVIEW.fields])
    return rows.select("key", "value", review.alias("review"), reason.alias("reason"))


def accepted(decoded: DataFrame) -> DataFrame:
    """The reviews among decoded messages."""
    return decoded.filter("reason is null").select("review.*")


def rejected(decoded: DataFrame) -> DataFrame:
    """(reason, key, value) of the messages that are no reviews, as they came."""
    return decoded.filter("reason is not null").select("reason", "key", "value")


def decode_reviews(raw: DataFrame) -> DataFrame:
    """The review columns of the messages that are reviews; the others are for ``rejected``."""
    return accepted(decode(raw))


def publish_reviews(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """Review rows -> keyed JSON messages (key = ProductId).

    Missing values stay JSON null (T3: never the text "nan"); Id/Time become
    longs and the label an int, as the message schema expects.
    """
    value = F.to_json(F.struct(
        F.col("Id").cast("long").alias("Id"),
        F.col("ProductId").cast("string").alias("ProductId"),
        F.col("UserId").cast("string").alias("UserId"),
        F.col("Time").cast("long").alias("Time"),
        F.col("Summary").cast("string").alias("Summary"),
        F.col("Text").cast("string").alias("Text"),
        F.col("cleaned").cast("string").alias("cleaned"),
        F.col(label_col).cast("int").alias("true_sentiment")))
    return df.select(F.col("ProductId").cast("string").alias("key"), value.alias("value"))


@_kafka_guard
def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """S5 sink: batch write of (key, value) messages to Kafka."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def write_message_files(messages: DataFrame, path: str, mode: str = "append") -> None:
    """S5 stand-in: (key, value) messages as JSON lines."""
    messages.write.mode(mode).json(path)


def live_records(scored: DataFrame) -> DataFrame:
    """Compact keyed live record {id, productId, summary, sentiment, confidence, time}."""
    # The keys of a live record.
    value = F.to_json(F.struct(
        F.col("Id").alias("id"), F.col("ProductId").alias("productId"), F.col("Summary").alias("summary"),
        F.col("sentiment_label").alias("sentiment"), F.col("confidence").alias("confidence"),
        F.col("Time").alias("time")))
    return scored.select(F.col("ProductId").cast("string").alias("key"), value.alias("value"))


def normalise_live(raw: DataFrame) -> DataFrame:
    """Live message -> display record; missing fields '' , summary cut to 120
    characters, confidence as double defaulting to 0.0."""
    d = F.from_json(F.col("value").cast("string"), LIVE_RECORD).alias("d")
    x = raw.select(d).select("d.*")
    return x.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col("productId"), F.lit("")).alias("productId"),
        F.substring(F.coalesce(F.col("summary"), F.lit("")), 1, 120).alias("summary"),
        F.coalesce(F.col("sentiment"), F.lit("")).alias("sentiment"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("time").cast("string"), F.lit("")).alias("time"))


@_kafka_guard
def read_live(spark: SparkSession, servers: str, topic: str = LIVE_TOPIC) -> DataFrame:
    """Consume the live topic from the latest offset, normalised."""
    return normalise_live(kafka_source(spark, servers, topic, "latest"))
