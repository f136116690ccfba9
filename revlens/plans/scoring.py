"""Scoring with a fitted pipeline (M6, P5, P6, P7, S11) -- batch and stream alike."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.labels import label_name

# The columns of a stored prediction and of the test export.
OUTPUT_COLUMNS = ["Id", "ProductId", "UserId", "Time", "Summary", "Text", "cleaned", "true_sentiment",
                  "prediction", "sentiment_label", "confidence"]
EXPORT_COLUMNS = ["Id", "ProductId", "UserId", "Time", "Summary", "Text", "sentiment",
                  "prediction", "sentiment_label"]


def confidence(prob_col: str = "probability"):
    """Highest class probability, 0.0 when missing; JVM side, no Python UDF."""
    return F.coalesce(F.array_max(vector_to_array(F.col(prob_col))), F.lit(0.0))


def score(model, df: DataFrame) -> DataFrame:
    """M6: transform, then name the label (NULL stays NULL, T2) and attach confidence."""
    out = model.transform(df)
    return (out.withColumn("sentiment_label", label_name("prediction"))
            .withColumn("confidence", confidence("probability")))


def prediction_record(scored: DataFrame) -> DataFrame:
    """The stored prediction columns."""
    return scored.select(*OUTPUT_COLUMNS)


def export_test_predictions(scored: DataFrame, path: str) -> None:
    """Nine-column CSV of the scored test set, written by the executors."""
    from revlens.sources.files import write_csv
    write_csv(scored.withColumn("sentiment_label", label_name("prediction")).select(*EXPORT_COLUMNS), path)
