"""Lemma dictionaries as tables (P3i): a given one (form, lemma), or one decided by the corpus itself.

``lemmatize_with`` has one plan at every dictionary size: each distinct text (by its SHA-256) is written once and
lies in a chunk of bounded length. The distinct words of a chunk are left-joined to the dictionary, and those that
change come back to the chunk's texts: no row is made for every token of every text.
Rows with a NULL or a repeated id keep their own words.

``corpus_lemmas`` detaches noun endings in every way they may have been attached, and takes
a base only if the corpus has it as a word: *zombies* may come from *zombie* or *zomby*, and the
more frequent of those that occur is the lemma; *christmas* keeps its s where no *christma* occurs.

The text should hold raw tokens (``clean_text(.., lemmatise=False)``).
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from revlens.functions.text import IRREGULAR_LEMMAS, SINGULAR_S, lemma
from revlens.session import checkpoint_dir

#: Characters of a chunk of texts, whose changed words are looked up together.
CHUNK_CHARS = 1 << 22

# Noun endings and what may stand in their place. Some endings have several.
DETACHMENTS = [("s", ""), ("ses", "s"), ("ses", "sis"), ("xes", "x"), ("zes", "z"), ("zzes", "z"), ("ches", "ch"), ("shes", "sh"),
               ("oes", "o"), ("ves", "f"), ("ves", "fe"), ("ies", "y"), ("men", "man")]
# Words with these endings are no plurals in s.
NO_PLURAL = ("ss",)


def lemmatize_with(df: DataFrame, lemmas: DataFrame, text_col: str = "cleaned", out_col: str | None = None,
                   rules: bool = True) -> DataFrame:
    """Lemmatise the space-separated tokens of ``text_col`` with a dictionary table; NULL texts give ''.

    Words that it lacks follow the built-in suffix rules, or stay as they are without ``rules``.
    """
    out_col = out_col or text_col
    dic = lemmas.select("form", "lemma").dropna().groupBy("form").agg(F.min("lemma").alias("lemma"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    texts = _chunks(df.select(key.alias("_key"), text.alias("_text")).dropDuplicates(["_key"]))
    toks = texts.select("_chunk", F.explode(F.array_distinct(F.split("_text", " "))).alias("tok")).filter(F.col("tok") != "").distinct()
    joined = toks.join(dic, toks["tok"] == dic["form"], "left")
    word = F.coalesce(F.col("lemma"), lemma(F.col("tok")) if rules else F.col("tok"))
    changed = joined.select(F.col("_chunk").alias("_of"), "tok", word.alias("word")).filter("tok <> word")
    per_text = texts.groupBy("_chunk").cogroup(changed.groupBy("_of")).applyInArrow(_put_words, "_key binary, _lem string")
    return (df.withColumn("_key", key).join(per_text, "_key", "left")
            .withColumn(out_col, F.coalesce(F.col("_lem"), F.lit(""))).drop("_lem", "_key"))


def _chunks(texts: DataFrame) -> DataFrame:
    """The texts, written once, with the chunk that each is in: a chunk has about ``CHUNK_CHARS`` characters."""
    spark = texts.sparkSession
    path, seen = os.path.join(checkpoint_dir(spark), f"lemma-texts-{uuid.uuid4().hex}"), Observation(f"lemma_{uuid.uuid4().hex}")
    texts.observe(seen, F.coalesce(F.sum(F.length("_text")), F.lit(0)).alias("chars")).write.parquet(path)
    chunks = max(1, -(-int(seen.get["chars"]) // CHUNK_CHARS))
    return spark.read.schema(texts.schema).parquet(path).withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.lit(chunks)))


def _put_words(texts: pa.Table, changed: pa.Table) -> pa.Table:
    """One chunk's texts with its changed words."""
    words = dict(zip(changed["tok"].to_pylist(), changed["word"].to_pylist()))
    put = [" ".join([words.get(w, w) for w in t.split(" ") if w]) for t in texts["_text"].to_pylist()]
    return pa.table({"_key": texts["_key"], "_lem": pa.array(put, pa.string())})


def vocabulary(df: DataFrame, text_col: str = "cleaned") -> DataFrame:
    """(word, n): how often each token occurs."""
    words = df.select(F.explode(F.split(F.col(text_col), " ")).alias("word")).filter(F.col("word") != "")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bases(word: str) -> Column:
    """The bases that a word may be the plural of, by detaching its endings; some may be no words."""
    w = F.col(word)
    cases = []
    for ending, rest in DETACHMENTS:
        fits = w.endswith(ending)
        if ending == "s":
            for other in NO_PLURAL:
                fits = fits & ~w.endswith(other)
        cases.append(F.when(fits, F.concat(w.substr(F.lit(1), F.length(w) - len(ending)), F.lit(rest))))
    return F.array_distinct(F.filter(F.array(*cases), lambda b: b.isNotNull()))


def corpus_lemmas(words: DataFrame, least: int = 1) -> DataFrame:
    """A dictionary (form, lemma) from a ``vocabulary``: every word with a base that occurs at least ``least`` times.

    Of several bases the most frequent is taken, then the first in the alphabet. Words known to
    be singular have none; irregular plurals have theirs whether it occurs or not.
    """
    irregular = F.create_map(*[F.lit(v) for kv in IRREGULAR_LEMMAS.items() for v in kv])
    forms = words.filter(~F.col("word").isin(*SINGULAR_S)).select("word", F.try_element_at(irregular, F.col("word")).alias("known"))
    known = forms.filter("known is not null").select(F.col("word").alias("form"), F.col("known").alias("lemma"))
    may = forms.filter("known is null").select(F.col("word").alias("form"), F.explode(bases("word")).alias("lemma"))
    found = may.join(words.filter(F.col("n") >= least).select(F.col("word").alias("lemma"), "n"), "lemma")
    best = Window.partitionBy("form").orderBy(F.desc("n"), "lemma")  # a form has a handful of bases
    return found.withColumn("k", F.row_number().over(best)).filter("k = 1").select("form", "lemma").unionByName(known)


def lemmatize_by_corpus(df: DataFrame, text_col: str = "cleaned", least: int = 1) -> DataFrame:
    """Raw tokens of ``text_col`` -> lemmas that the same texts decide; a word without an occurring base stays."""
    return lemmatize_with(df, corpus_lemmas(vocabulary(df, text_col), least), text_col, rules=False)
