"""Lemmas decided by the corpus, and the dictionary join."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import lemmas

# The texts hold each base at least once; what has none there stays as it is.
TEXTS = [
    (1, "zombies genies selfies quizzes oases christmas physics"), (2, "zombie zombie genie selfie quiz quiz oasis"),
    (3, "boxes box dishes dish churches church heroes tomatoes wolves knives knife thieves thief"),
    (4, "glass glasses class classes bus buses gas virus viruses lens news new species firemen fireman"),
    (5, "berries berry cookies cookie movies movie pies tie ties dies"), (6, ""), (7, None), (7, "zombies berry"), (None, "boxes  box"),
    (8, "axes axe ax axis"), (9, "caches cache cache cach"), (10, "zombies genies selfies quizzes oases christmas physics")]
WANT = {
    "zombies": "zombie", "genies": "genie", "selfies": "selfie", "quizzes": "quiz", "oases": "oasis", "christmas": "christmas",
    "physics": "physics", "boxes": "box", "dishes": "dish", "churches": "church", "heroes": "hero", "tomatoes": "tomato",
    "wolves": "wolf", "knives": "knife", "thieves": "thief", "glass": "glass", "glasses": "glass", "classes": "class",
    "buses": "bus", "bus": "bus", "gas": "gas", "virus": "virus", "viruses": "virus", "lens": "lens", "news": "news",
    "species": "species", "firemen": "fireman", "berries": "berry", "cookies": "cookie", "movies": "movie", "pies": "pie",
    "ties": "tie", "dies": "dies", "axis": "axis", "caches": "cache"}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "Id long, cleaned string")


def test_each_word_gets_the_base_that_the_corpus_has(spark, texts):
    words = lemmas.vocabulary(texts)
    dic = {r.form: r.lemma for r in lemmas.corpus_lemmas(words).collect()}
    assert len(dic) == lemmas.corpus_lemmas(words).count()
    assert {w: dic.get(w, w) for w in WANT} == WANT
    assert dic["axes"] in ("ax", "axe")  # both occur once: the first in the alphabet
    assert dic["axes"] == "ax"


def test_a_base_must_occur_often_enough(spark, texts):
    dic = {r.form: r.lemma for r in lemmas.corpus_lemmas(lemmas.vocabulary(texts), least=2).collect()}
    assert dic["zombies"] == "zombie" and dic["quizzes"] == "quiz" and "genies" not in dic and dic["caches"] == "cache"
    assert dic["movies"] == "movie"  # irregular plurals do not ask


def test_texts_keep_their_rows_and_word_order(spark, texts):
    frame = texts.withColumns({c: F.lit("clash") for c in ("form", "lemma", "word", "n", "pos", "tok")})
    got = sorted(((r.Id, r.cleaned) for r in lemmas.lemmatize_by_corpus(frame).collect()), key=str)
    want = sorted(((i, " ".join(WANT.get(w, "ax" if w == "axes" else w) for w in (t or "").split())) for i, t in TEXTS), key=str)
    assert got == want


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "Id long, cleaned string")
    assert lemmas.lemmatize_by_corpus(none).count() == 0 and lemmas.corpus_lemmas(lemmas.vocabulary(none)).count() == 0


def test_dictionary_join_takes_the_least_lemma_and_skips_nulls(spark, texts):
    dic = spark.createDataFrame([("zombies", "z"), ("zombies", "a"), (None, "x"), ("box", None)], "form string, lemma string")
    got = {(r.Id, r.cleaned) for r in lemmas.lemmatize_with(texts, dic, rules=False).collect()}
    assert (7, "a berry") in got and (7, "") in got and (None, "boxes box") in got


@pytest.mark.parametrize("chars", [40, 1 << 22])
def test_only_the_distinct_words_of_a_chunk_become_rows(spark, texts, monkeypatch, chars):
    monkeypatch.setattr(lemmas, "CHUNK_CHARS", chars, raising=False)
    many = texts.union(spark.createDataFrame([(11, "zombies box zombies " * 3000), (12, "zombies box zombies " * 3000)], texts.schema))
    dic = spark.createDataFrame([("zombies", "z")], "form string, lemma string")
    out = lemmas.lemmatize_with(many, dic, rules=False)
    got = {r.Id: r.cleaned for r in out.filter("Id > 7").collect()}
    assert got[11] == got[12] == " ".join(["z box z"] * 3000) and got[10].startswith("z genies") and got[8] == "axes axe ax axis"
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
