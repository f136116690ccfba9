"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's docs.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``. NULL and empty texts go
with language identification (they have no letter); repeated rows of one id
are judged each, and near-duplicate removal leaves one row of each group of near copies, with or
without an id; an id stays more than once only with texts that are no copies of each other.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import language, mixing, packing, quality, simhash
from revlens.llm.common import materialize, whole_row
from revlens.session import checkpoint_dir
from revlens.sources.tables import table

# A language is believed from this score on.
LANGUAGE_SCORE = 0.4
MIX_WEIGHTS = {"lang": {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, or whose language is not believed, go."""
    net = language.train(language.training_sample(docs))
    judged = docs.select(whole_row(docs), language.predict_column(net, "text").alias("judged"))
    keep = (F.col("judged.lang_pred") != language.UNKNOWN) & (F.col("judged.score") >= LANGUAGE_SCORE)
    return judged.filter(keep).select("row.*")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that it predicts to be poor go, each by its own score, with or without an id."""
    rows = materialize(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("quality_row")), "pipeline-quality")
    seen = rows.select(*[f"row.{c}" for c in ("doc_id", "text", "lang", "source", "n_chars")], "quality_row")
    scored = quality.score_documents(seen, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"), keep=("quality_row",))
    good = scored.filter("predicted = 1").select("quality_row")
    return rows.join(good, "quality_row", "left_semi").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near copies one row stays, with its own text.

    It is the row with the smallest id; of several rows of that id the one with the smallest
    text hash. Rows are judged by their own text: an id that carries texts of several
    groups may stay once for each, and a group without any id keeps one row with a NULL id.
    """
    # Written once, so that a recomputed task meets the same row keys.
    rows = materialize(docs.select(
        whole_row(docs), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("dedup_row"),
        simhash.simhash_column("text", width=3).alias("fp"), F.xxhash64("text").alias("hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")), "pipeline-dedup")
    groups = simhash.fingerprint_groups(rows.select("id", "fp"), max_distance=2)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "rest", "dedup_row")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    keep = first.join(groups, "fp").groupBy("root").agg(F.min("first")["dedup_row"].alias("dedup_row")).select("dedup_row")
    return rows.join(keep, "dedup_row", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token budgets by domain, language and source; a document stands once for each epoch that takes it."""
    return mixing.mix_rows(docs, MIX_WEIGHTS, budget_share=1.0, max_epochs=2).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every row's pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Training, SimHash (XXH64) and tokenisation cannot be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; every stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(checkpoint_dir(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
