"""Scalar functions on literal edge cases (FIXTURES section 2)."""

import math

import pytest
from pyspark.sql import functions as F

from revlens.functions import hashing, labels, mathfn, text, timefn


def col_values(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_text_reference_examples(spark):
    got = col_values(spark, ["This is <br/> GREAT product!!! ??<h1>http://amazon.com \U0001F44D",
                             "Not as advertised,w22112 very disappointed..."], text.clean_text)
    assert got == ["great product", "not advertised disappointed"]


@pytest.mark.parametrize("raw,expected", [
    (None, ""), ("", ""), ("   \t ", ""), ("<p><br/></p>", ""),
    ("good <b\nc> thing", "good thing"),            # a tag never spans a newline
    ("good <bad\rword> thing", "good thing"),       # ... but does span a carriage return (T19)
    ("see http://x.com/a great deal", "see great deal"),   # no-break space ends a URL
    ("visit www.shop.com", "visit"),
    ("not good", "not good"), ("no", ""), ("don't like it", "like"),
    ("boxes of glasses and cherries", "box glass cherry"),
    ("the children bought two boxes", "child bought two box"),
    ("analysis of gas bus", "analysis gas bus"),
])
def test_clean_text_cases(spark, raw, expected):
    assert col_values(spark, [raw], text.clean_text) == [expected]


def test_fill_cleaned_only_when_missing(spark):
    df = spark.createDataFrame([("kept text", "S", "T"), (None, "Great", "Soup!"), ("", None, None)],
                               "cleaned string, Summary string, Text string")
    got = [r[0] for r in df.select(text.fill_cleaned()).collect()]
    assert got == ["kept text", "great soup", ""]


def test_score_and_prediction_labels(spark):
    df = spark.createDataFrame([(s,) for s in [1, 2, 3, 4, 5, None]], "s int")
    assert [r[0] for r in df.select(labels.score_to_label("s")).collect()] == [0, 0, 1, 2, 2, None]
    df = spark.createDataFrame([(p,) for p in [0.0, 1.0, 2.0, None]], "p double")
    assert [r[0] for r in df.select(labels.label_name("p")).collect()] == ["negative", "neutral", "positive", None]


def test_normalise_time_bounds(spark):
    vals = [788918399, 788918400, 1893456000, 1893456001, 4000000001, 1303862400000, None]
    df = spark.createDataFrame([(v,) for v in vals], "t long")
    got = [tuple(r) for r in df.select(timefn.normalise_time("t"), timefn.display_date("t")).collect()]
    assert got == [(None, ""), (788918400, "1995-01-01"), (1893456000, "2030-01-01"), (None, ""),
                   (None, ""), (1303862400, "2011-04-27"), (None, "")]


def test_share_is_exact_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (0, 0), (5, 400)], "p long, t long")
    got = [r[0] for r in df.select(mathfn.share("p", "t", 100, 1)).collect()]
    assert got == [12.5, 33.3, 66.7, 0.0, 1.3]


def test_unit_hash_matches_sql_and_is_uniform(spark):
    import duckdb
    df = spark.range(0, 2000).select(hashing.unit_hash("id", 42).alias("u"))
    us = [r[0] for r in df.collect()]
    assert all(0.0 <= u < 1.0 for u in us)
    assert abs(sum(us) / len(us) - 0.5) < 0.03
    sql = duckdb.sql(f"select {hashing.unit_hash_sql('range', 42)} as u from range(2000) order by range").fetchall()
    assert [r[0] for r in sql] == us
    assert not math.isclose(us[0], us[1])


def test_shuffle_partitions_for():
    from revlens.session import shuffle_partitions_for
    assert shuffle_partitions_for(10) == 200
    assert shuffle_partitions_for(100 * 1024 ** 4) == 100_000
    assert shuffle_partitions_for(1024 ** 4) == 4096


def test_shared_schemas_are_not_mutated(spark, tmp_path):
    from revlens import schemas
    from revlens.sources import files
    from revlens.streaming import monitors
    before = (len(schemas.PREDICTION.fields), len(schemas.SPLIT_REVIEW.fields))
    monitors.tail_predictions(spark, str(tmp_path))
    files.read_splits(spark, str(tmp_path), fmt="csv")
    assert (len(schemas.PREDICTION.fields), len(schemas.SPLIT_REVIEW.fields)) == before


def test_in_year_raw_equals_year_of_repaired_time(spark):
    """The stored-value prefilter keeps exactly the rows whose repaired time is in the year."""
    import datetime as dt
    lo = int(dt.datetime(2011, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    hi = int(dt.datetime(2012, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    vals = [lo - 1, lo, lo + 1, hi - 1, hi, hi + 1, lo * 1000 - 1, lo * 1000, hi * 1000 - 1, hi * 1000,
            (lo + 5) * 1000 + 999, 4000000000, 4000000001, 0, -5, None]
    df = spark.createDataFrame([(v,) for v in vals], "Time long")
    got = df.withColumn("_t", timefn.normalise_time("Time")).select(
        "Time", F.coalesce(timefn.in_year_raw(2011, "Time"), F.lit(False)).alias("raw"),
        F.coalesce(timefn.in_year(2011, "_t"), F.lit(False)).alias("exact"))
    for r in got.collect():
        assert bool(r.raw) == r.exact, r


def test_cleaning_skips_no_markup(spark):
    """Texts with and without the marks that the searches for tags and addresses ask for first."""
    texts = ["Tea <br/>leaves WWW.x.y/z mice", "HTTPS://a.b cats' <i>", "a <b\n> www x", "", None, "12 34", "<>www.", "zombies' men's news"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(text.clean_text("t")).collect()]
    assert got == ["tea leaf mouse", "cat", "www", "", "", "", "www", "zomby man news"]
    words = sorted(set(text.IRREGULAR_LEMMAS) | set(text.SINGULAR_S) | {"glasses", "men", "tea", "feet", "ass", "xs", "s", ""})
    w = spark.createDataFrame([(x,) for x in words], "w string")
    irregular = F.create_map(*[F.lit(v) for kv in text.IRREGULAR_LEMMAS.items() for v in kv])
    plain = F.coalesce(F.try_element_at(irregular, F.col("w")), text.lemma_rule(F.col("w")))
    assert w.filter(~text.lemma(F.col("w")).eqNullSafe(plain)).count() == 0
