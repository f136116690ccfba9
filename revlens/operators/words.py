"""Word frequencies per label (A19, W1, W2) and the per-label sampler."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.hashing import unit_hash
from revlens.functions.labels import LABELS
from revlens.functions.text import text_length

# Words left out of the word cloud.
WORD_STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "from", "have", "has", "had", "not", "but", "you",
    "are", "was", "were", "its", "their", "they", "them", "there", "here", "into", "also", "just",
    "very", "much", "more", "most", "some", "any", "all", "one", "two", "get", "got", "than", "then",
    "out", "our", "your", "his", "her", "him", "she", "could", "would", "should", "about", "because",
    "what", "when", "where", "which", "who", "why", "how", "like", "really", "made", "make", "makes",
    "amazon", "product", "item", "ordered", "order", "bought", "buy", "received",
    "good", "great", "love", "loved", "best", "nice", "perfect", "awesome", "excellent", "tasty",
    "bad", "worst", "horrible", "terrible", "awful", "disappointed", "disappointing",
]
WORD_RE = "^[a-z]{3,15}$"


def word_source(df: DataFrame) -> DataFrame:
    """The text a word count reads: cleaned when longer than 2 characters, else Text."""
    src = F.when(text_length("cleaned") > 2, F.col("cleaned")).otherwise(F.coalesce(F.col("Text"), F.lit("")))
    return df.select(F.col("sentiment_label").alias("label"), src.alias("src"))


def word_counts(df: DataFrame) -> DataFrame:
    """(label, word, n) over all rows with a known label.

    explode + filter + groupBy: partial counts per task, shuffle keyed by
    (label, word) so a dominant label still spreads over all reducers.
    """
    words = (word_source(df.filter(F.col("sentiment_label").isin(*LABELS)))
             .select("label", F.explode(F.split(F.lower("src"), " ")).alias("word"))
             .filter(~F.col("word").isin(*WORD_STOPWORDS) & F.col("word").rlike(WORD_RE)))
    return words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, limit: int = 25) -> DataFrame:
    """W1 + W2: top ``limit`` words per label (ties by word) and cloud size 10..42.

    ``row_number() <= limit`` lets Spark insert a partial WindowGroupLimit
    before the shuffle, so each label's final task sees at most
    ``limit`` rows per upstream task.
    """
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), F.asc("word")))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= limit)
    mx = F.max("n").over(Window.partitionBy("label"))
    # JavaScript Math.round == floor(x + 0.5)
    size = F.lit(10) + F.floor(F.col("n") / mx * 32 + 0.5).cast("int")
    return top.withColumn("size", size).select("label", "rank", "word", "n", "size")


def word_frequencies(df: DataFrame, limit: int = 25, sample_per_label: int | None = None,
                     seed: int = 42) -> DataFrame:
    """Per label, the most frequent words of the review texts.

    With ``sample_per_label`` the reference's random 5000-review sample is
    reproduced deterministically (``sample_by_label``); by default all rows count.
    """
    if sample_per_label:
        df = sample_by_label(df, sample_per_label, "sentiment_label", "Id", seed)
    return top_words(word_counts(df), limit)


def sample_by_label(df: DataFrame, k: int, label_col: str = "sentiment_label",
                    key_col: str = "Id", seed: int = 42) -> DataFrame:
    """Exactly min(k, n_label) rows per label, chosen by a seeded hash of the key.

    1. count rows per label (tiny result, one row per label);
    2. keep rows whose hash falls below a per-label threshold sized for
       k plus a safety margin -- a map-side filter, no shuffle;
    3. rank only those candidates per label and keep the first k
       (bounded groups of about k rows).
    A label whose candidates fall short of k is redone with threshold 1,
    so the result is exact.
    """
    u = unit_hash(key_col, seed, "sample")
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}

    def threshold(n):
        return 1.0 if n <= k else min(1.0, (k + 6 * math.sqrt(k) + 20) / n)

    def pick(thr):
        cond = F.lit(False)
        for lab, n in counts.items():
            key = F.col(label_col).isNull() if lab is None else (F.col(label_col) == lab)
            cond = cond | (key & (F.col("_u") < F.lit(thr(lab, n))))
        cand = df.withColumn("_u", u).filter(cond)
        rn = F.row_number().over(Window.partitionBy(label_col).orderBy("_u", key_col))
        return cand.withColumn("_rn", rn).filter(F.col("_rn") <= k)

    first = pick(lambda lab, n: threshold(n))
    got = {r[0]: r[1] for r in first.groupBy(label_col).count().collect()}
    short = {lab for lab, n in counts.items() if got.get(lab, 0) < min(k, n)}
    if short:
        first = pick(lambda lab, n: 1.0 if lab in short else threshold(n))
    return first.drop("_u", "_rn")
