"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (ann, conversation_repair, fingerprints, language, line_dedup, mixing, packing, prefix_trie, quality, simhash,
                         toxicity, url_reputation, warc)
from revlens.llm.common import materialize
from revlens.sources.tables import table


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_distance=2)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_WEIGHTS = {"domain": {"family0": 3.0, "family1": 2.0, "family2": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}}


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, MIX_WEIGHTS, budget_share=0.6, max_epochs=2, keep=["doc_id", "lang", "source"])


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    none = F.lit(-1).cast("long")
    return found.withColumns({"headers": warc.header_text(F.col("headers")), "length": F.coalesce("length", none),
                              "response_id": F.coalesce("response_id", none)})


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                   table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), threshold=10, least=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(rows, conversation_repair.damage(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialize(prefix_trie.conversation_keys(table(spark, sf_dir, "conversations")), "trie-own")
    return prefix_trie.trie_with_ends(materialize(prefix_trie.with_shared_heads(own), "trie-rebuilt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_reputation": op1_host_reputation,
    "op2_string_kernel_toxicity": op2_string_kernel_toxicity,
    "op3_one_permutation_minhash": op3_one_permutation_minhash,
    "op4_byte_cnn_language": op4_byte_cnn_language,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_shortest_pack_first": op6_shortest_pack_first,
    "op7_revisit_resolution": op7_revisit_resolution,
    "op8_hierarchical_mixing": op8_hierarchical_mixing,
    "op9_permutation_index": op9_permutation_index,
    "op10_cotraining_quality": op10_cotraining_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_glr_repair": op12_glr_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op1_host_reputation": url_reputation.ORACLE, "op7_revisit_resolution": warc.ORACLE,
                           "op11_line_dedup": line_dedup.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
