"""The registered queries on the smallest tables, their SQL, and the pipeline's stages against brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from oracle_compare import digest, duck, spark_pdf
from revlens.llm import language, quality, queries, simhash
from revlens.sources.tables import table


def test_queries_are_registered_once_per_operator():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert digest(spark_pdf(queries.QUERIES[name](spark, SF_SMALL))) == digest(duck(SF_SMALL).sql(queries.ORACLES[name]).df())


def test_held_out_language_and_toxicity(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF_SMALL, "documents").collect()}
    got = queries.QUERIES["op4_byte_cnn_language"](spark, SF_SMALL).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    toxic = queries.QUERIES["op2_string_kernel_toxicity"](spark, SF_SMALL).collect()
    assert len(toxic) == len(docs) and all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in toxic)


def test_stages_take_effect_one_by_one(spark, scratch):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{scratch}/{name}"
        stage(spark, docs, SF_SMALL).write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns
    ids = {k: ([r["doc_id"] for r in a.select("doc_id").collect()], [r["doc_id"] for r in b.select("doc_id").collect()])
           for k, (a, b) in seen.items()}
    # Filters keep a subset, in whole rows; nothing clean is lost to the language stage.
    for k in ("language", "quality", "simhash_near_dedup"):
        assert set(ids[k][1]) <= set(ids[k][0])
    assert len(ids["language"][1]) > 0.95 * len(ids["language"][0])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF_SMALL, "labels").collect()}
    gone = set(ids["quality"][0]) - set(ids["quality"][1])
    good = [i for i in ids["quality"][0] if labels.get(i) == 1]
    assert sum(i in gone for i in good) <= 0.03 * len(good)
    # One document stays of each SimHash group of the stage's own input.
    fp = {r["doc_id"]: simhash.simhash(r["text"]) for r in seen["simhash_near_dedup"][0].collect()}
    part = {i: i for i in fp}
    for _ in fp:
        changed = False
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 2 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
        if not changed:
            break
    assert sorted(ids["simhash_near_dedup"][1]) == sorted(set(part.values()))
    # Mixing repeats a document at most twice and invents none; packing places each of its rows.
    assert set(ids["mixing"][1]) <= set(ids["mixing"][0])
    assert max(ids["mixing"][1].count(i) for i in set(ids["mixing"][1])) <= 2
    starts = [r["doc_id"] for r in seen["packing"][1].filter("start = 0").collect()]
    assert sorted(starts) == sorted(ids["packing"][0])


def test_pipeline_survives_odd_and_empty_documents(spark, scratch):
    real = table(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "src1", 0),
                                 (0, "again", "en", "src0", 5), (None, "no id but words", "en", "src0", 15)], real.schema)
    for start, least in ((real.unionByName(odd), 100), (real.limit(0), 0)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{scratch}/{least}-{name}"
            stage(spark, docs, SF_SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
            if name == "language":
                assert docs.filter("doc_id >= 1000000").count() == 0
        assert docs.count() >= least


CLASHES = ["row", "judged", "judged_language", "quality_row", "dedup_row", "dedup_fp", "dedup_hash", "dedup_rest", "id", "fp", "hash", "rest",
           "root", "first", "mix_domain", "mix_epoch", "mix_tokens", "mix_id", "mix_lang", "mix_source", "mix_epochs", "mix_edge", "found",
           "edge_id", "score", "predicted", "lang_pred", "toxic", "quality", "with.dot"]


def test_columns_with_the_stages_own_names_come_back_unchanged(spark, scratch):
    docs = table(spark, SF_SMALL, "documents").limit(60)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF_SMALL)
        assert got.columns == docs.columns, name
        path = f"{scratch}/{name}"
        got.write.parquet(path)
        rows = spark.read.parquet(path).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES), name
    packed = corpus_pipeline.pack(spark, docs, SF_SMALL)
    assert len(set(packed.columns)) == len(packed.columns) and packed.count() >= 60


def test_language_rejects_only_the_unreadable():
    assert language.predict(None, ["12 34"])[0] == ["und"]


def test_near_dedup_keeps_one_row_of_each_group_with_or_without_an_id(spark):
    first, second, third, fourth = (" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(3, first), (5, first), (5, second), (0, "again"), (0, third), (None, "no id but words"), (None, fourth),
            (None, fourth), (None, third), (9, third), (5, second)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], table(spark, SF_SMALL, "documents").schema)
    for n in (1, 5):
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), SF_SMALL).collect()]
        assert sorted(got, key=str) == sorted([(3, first), (5, second), (0, "again"), (0, third), (None, "no id but words"),
                                               (None, fourth)], key=str)


def test_quality_stage_rejects_each_row_that_the_operator_predicts_poor(spark, scratch):
    def text(i, good):
        return " ".join(f"{'alpha beta gamma delta'.split()[(i * k) % 4]}" + ("" if good else "###") for k in range(30 + i % 40))
    rows = [(i, text(i, i % 4 > 0)) for i in range(400)] + [(None, text(8, False)), (None, text(9, True)), (5, text(12, False))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], table(spark, SF_SMALL, "documents").schema)
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400) if i % 3], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{scratch}/labels.parquet")
    table(spark, SF_SMALL, "pages").limit(0).write.parquet(f"{scratch}/pages.parquet")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.judge_quality(spark, docs, scratch).collect()]
    assert {(i, "###" in t) for i, t in left if i is None or i == 5} == {(None, False), (5, False)}
    assert sum("###" in t for _, t in left) <= 0.02 * 102 and sum("###" not in t for _, t in left) >= 0.98 * 301


def test_quality_stage_takes_the_operators_decision(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    scored = quality.score_documents(docs, labels, table(spark, SF_MID, "pages")).collect()
    left = [r["doc_id"] for r in corpus_pipeline.judge_quality(spark, docs, SF_MID).select("doc_id").collect()]
    assert sorted(left) == sorted(r["doc_id"] for r in scored if r["predicted"])
    poor = {r["doc_id"] for r in labels.filter("quality = 0").collect()} & {r["doc_id"] for r in scored}
    assert poor and len(poor & set(left)) <= 0.1 * len(poor)


def test_quality_stage_has_no_threshold_of_its_own(spark, monkeypatch):
    def scored(docs, *_, keep=(), **__):
        score = F.col("n_chars") / 100
        return docs.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *keep)
    monkeypatch.setattr(quality, "score_documents", scored)
    docs = spark.createDataFrame([(i, "a b", "en", "src0", n) for i, n in ((1, 40), (2, 50), (3, 20), (3, 90), (None, 40), (None, 60))],
                                 table(spark, SF_SMALL, "documents").schema)
    left = [(r["doc_id"], r["n_chars"]) for r in corpus_pipeline.judge_quality(spark, docs, SF_SMALL).collect()]
    assert sorted(left, key=str) == [(2, 50), (3, 90), (None, 60)]
