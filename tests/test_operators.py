"""Operators on small literal frames: nulls, ties, bin edges, empty input."""

import datetime as dt

from pyspark.sql import functions as F

from revlens.operators import (distribution, evaluation, feed, prep, products, profile, quality, trends,
                               words)
from revlens.schemas import PREDICTION

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def preds(spark, rows):
    """rows: dicts with any PREDICTION fields; the rest are NULL."""
    names = [f.name for f in PREDICTION.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PREDICTION)


def test_confidence_histogram_bins(spark):
    confs = [None, float("nan"), 0.33, 0.55, 0.95, 1.0]
    df = preds(spark, [{"sentiment_label": "positive", "confidence": c} for c in confs])
    got = {(r.label, r.bin): r.n for r in evaluation.confidence_histogram(df).collect()}
    assert len(got) == 30
    assert got[("positive", 0)] == 3 and got[("positive", 1)] == 1 and got[("positive", 9)] == 2
    assert sum(got.values()) == len(confs)


def test_product_histogram_excludes_one(spark):
    df = preds(spark, [{"ProductId": "p", "confidence": c} for c in [None, 0.33, 0.55, 0.95, 1.0]])
    got = [(r.bin, r.n) for r in evaluation.product_confidence_histogram(df, "p").collect()]
    assert got == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_confusion_matrix_is_full_grid(spark):
    df = preds(spark, [{"true_sentiment": 0, "prediction": 0.0}, {"true_sentiment": 2, "prediction": 1.0},
                       {"true_sentiment": None, "prediction": 1.0}, {"true_sentiment": 1, "prediction": None},
                       {"true_sentiment": 5, "prediction": 1.0}])
    got = {(r.true_label, r.predicted_label): r.n for r in evaluation.confusion_matrix(df).collect()}
    assert len(got) == 9 and sum(got.values()) == 2
    assert got[("negative", "negative")] == 1 and got[("positive", "neutral")] == 1


def test_metrics_match_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as E
    rows = [(0, 0.0), (0, 1.0), (1, 1.0), (2, 2.0), (2, 2.0), (2, 0.0), (1, 2.0)]
    df = spark.createDataFrame(rows, "sentiment int, prediction double")
    m = evaluation.model_metrics(df, "sentiment", "prediction").first()
    d = df.withColumn("sentiment", F.col("sentiment").cast("double"))
    for name, key in [("f1", "f1_weighted"), ("accuracy", "accuracy"),
                      ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall")]:
        assert abs(E(labelCol="sentiment", metricName=name).evaluate(d) - m[key]) < 1e-6


def test_yearly_trend_null_label_adds_to_neutral(spark):
    t = 1262304000  # 2010-01-01
    df = preds(spark, [{"Time": t, "sentiment_label": None}, {"Time": t, "sentiment_label": "neutral"},
                       {"Time": t, "sentiment_label": "positive"}, {"Time": 100, "sentiment_label": "positive"}])
    assert [tuple(r) for r in trends.yearly_trend(df).collect()] == [("2010", 1, 2, 0)]


def test_monthly_trend_zero_filled(spark):
    df = preds(spark, [{"Time": 1267401600, "sentiment_label": "negative"}])  # 2010-03-01
    rows = trends.monthly_trend(df, 2010).collect()
    assert [r.month for r in rows][:3] == ["Jan", "Feb", "Mar"] and len(rows) == 12
    assert rows[2].negative == 1 and sum(r.negative for r in rows) == 1


def test_top_products_ties_and_nulls(spark):
    df = preds(spark, [{"ProductId": p, "sentiment_label": "positive"} for p in ["b", "a", "b", "a", None, None, "c"]])
    assert [(r.id, r["count"]) for r in products.top_products(df, "positive", 3).collect()] == \
        [("a", 2), ("b", 2), (None, 2)]
    assert [r.id for r in products.all_products(df, 3).collect()] == ["a", "b", "c"]


def test_product_pages(spark):
    df = preds(spark, [{"Id": i, "ProductId": "p", "Time": 1262304000 + i, "sentiment_label": "neutral"}
                       for i in range(5)])
    page1 = products.product_reviews(df, "p", None, page=0, page_size=2).collect()
    assert [r.id for r in page1] == ["4", "3"] and page1[0].total == 5 and page1[0].page == 1
    assert products.product_reviews(df, "p", None, page=9, page_size=2).count() == 0
    assert products.product_summary(df, "missing").count() == 0


def test_search_and_format(spark):
    df = preds(spark, [{"Id": 1, "Summary": "Nice TEA", "Text": "x", "prediction": None},
                       {"Id": 2, "Summary": None, "Text": "tea time", "sentiment_label": "positive"},
                       {"Id": 3, "Summary": "coffee", "Text": None}])
    assert [r.Id for r in feed.search(df, "tea").collect()] == [1, 2]
    assert feed.search(df, "").count() == 0
    assert [r.Id for r in feed.search(df, "(tea").collect()] == []   # bad pattern -> literal search
    f = feed.format_prediction(df).orderBy("id").collect()
    assert f[0].sentiment == "negative" and f[0].summary == "Nice TEA" and f[1].sentiment == "positive"


def test_label_shares_empty_table(spark):
    df = preds(spark, [])
    assert [tuple(r) for r in distribution.label_shares(df).collect()] == \
        [("negative", 0, 0.0), ("neutral", 0, 0.0), ("positive", 0, 0.0)]


def _keyed(spark, n, unlabelled=0, positive=0, lag_s=0):
    rows = []
    for i in range(n):
        lab = None if i < unlabelled else ("positive" if i < unlabelled + positive else "neutral")
        rows.append({"Id": i, "sentiment_label": lab, "confidence": 0.9,
                     "inserted_at": T0 - dt.timedelta(seconds=lag_s + i % 3)})
    return preds(spark, rows)


def test_quality_thresholds(spark):
    now = T0
    q10 = {r.check: r.status for r in quality.prediction_quality(_keyed(spark, 50, unlabelled=10)).collect()}
    q11 = {r.check: r.status for r in quality.prediction_quality(_keyed(spark, 50, unlabelled=11)).collect()}
    assert q10["prediction_labels"] == "ok" and q11["prediction_labels"] == "fail"
    assert quality.balance(_keyed(spark, 99, positive=99)).first().status == "skip"
    assert quality.balance(_keyed(spark, 100, positive=95)).first().status == "ok"
    assert quality.balance(_keyed(spark, 100, positive=96)).first().status == "fail"
    assert quality.latency(_keyed(spark, 1, lag_s=60), now).first().status == "ok"
    assert quality.latency(_keyed(spark, 1, lag_s=61), now).first().status == "fail"
    assert quality.freshness(_keyed(spark, 3, lag_s=121), now).first().status == "fail"
    assert quality.freshness(preds(spark, []), now).first().status == "skip"


def test_report_skips_after_failure(spark):
    df = _keyed(spark, 100, positive=100, lag_s=300)
    rep = quality.report(quality.freshness(df, T0), quality.prediction_quality(df),
                         quality.latency(df, T0), quality.balance(df)).collect()
    st = {r.check: r.status for r in rep}
    assert st["stats_freshness"] == "fail" and st["pipeline_latency"] == "skip" and st["sentiment_balance"] == "skip"


def test_traffic_snapshots(spark):
    snaps = spark.createDataFrame([(T0, "t", 0), (T0 + dt.timedelta(minutes=5), "t", 10),
                                   (T0 + dt.timedelta(minutes=10), "t", 10), (T0 + dt.timedelta(minutes=15), "t", 12)],
                                  "run_time timestamp, topic string, total long")
    assert [r.status for r in quality.traffic(snaps).orderBy("run_time").collect()] == ["skip", "ok", "fail", "ok"]


def _snapshots_brute(ts_list, step):
    """Every run end from the first to the last event's interval, with the events so far."""
    ends = sorted({(int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // step + 1) * step for t in ts_list})
    out, lo, hi = [], ends[0], ends[-1]
    secs = [int(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in ts_list]
    for e in range(lo, hi + 1, step):
        out.append((e, sum(1 for x in secs if x < e)))
    return out


def test_event_snapshots_axis_matches_brute_force(spark):
    """The per-day axis generation gives every interval end once, including steps that
    do not divide a day and steps longer than a day, and running totals across days."""
    base = dt.datetime(2024, 1, 1, 23, 53, 0)
    ts = [base + dt.timedelta(minutes=m) for m in (0, 3, 9, 61, 1500, 1501, 4000, 9000)]
    events = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    for minutes in (5, 7, 1441, 2000):
        got = [(int(r.run_time.replace(tzinfo=dt.timezone.utc).timestamp()), r.total)
               for r in quality.event_snapshots(events, every_minutes=minutes).orderBy("run_time").collect()]
        assert got == _snapshots_brute(ts, minutes * 60), minutes


def test_split_and_undersample(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("Id"), (F.col("id") % 10).alias("m"))
    df = df.withColumn("sentiment", F.when(F.col("m") < 1, 1).when(F.col("m") < 2, 0).otherwise(2))
    s = prep.stratified_split(df).cache()
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and 2200 < counts["train"] < 2600
    assert s.select("Id").distinct().count() == 3000
    bal = prep.undersample_majority(df)
    c = {r.sentiment: r["count"] for r in bal.groupBy("sentiment").count().collect()}
    assert c[0] == 300 and c[1] == 300 and 700 < c[2] < 1100
    w = {r.sentiment: r.classWeight for r in prep.class_weights(bal).collect()}
    assert abs(w[0] - sum(c.values()) / 900) < 1e-9


def test_sample_by_label_exact(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("Id"),
                                     F.when(F.col("id") % 5 == 0, "negative").otherwise("positive").alias("sentiment_label"))
    got = {r.sentiment_label: r["count"] for r in words.sample_by_label(df, 300).groupBy("sentiment_label").count().collect()}
    assert got == {"negative": 300, "positive": 300}
    small = words.sample_by_label(df, 2000)
    assert small.filter("sentiment_label = 'negative'").count() == 1000


def test_word_frequencies_ties_and_sizes(spark):
    df = preds(spark, [{"sentiment_label": "positive", "cleaned": "apple banana apple cherry banana the good"},
                       {"sentiment_label": "negative", "cleaned": "ab", "Text": "Lemon lemon LIME"}])
    got = [tuple(r) for r in words.word_frequencies(df, 2).orderBy("label", "rank").collect()]
    assert got == [("negative", 1, "lemon", 2, 42), ("negative", 2, "lime", 1, 26),
                   ("positive", 1, "apple", 2, 42), ("positive", 2, "banana", 2, 42)]


def test_profile(spark):
    df = spark.createDataFrame([(1, None, "ab"), (2, "xyz", None)], "Id long, Summary string, Text string")
    prof = {r.column: r.nulls for r in profile.null_profile(df).collect()}
    assert prof == {"Id": 0, "Summary": 1, "Text": 1}
    st = profile.text_length_stats(df).first()
    assert st.avg_text_len == 1.0 and st.avg_summary_len == 1.5 and st.summary_nulls == 1


def test_heatmap_grid(spark):
    df = preds(spark, [{"inserted_at": dt.datetime(2024, 1, 1, 5, 0), "sentiment_label": "positive"}])  # a Monday
    rows = trends.activity_heatmap(df).collect()
    assert len(rows) == 168
    hit = [r for r in rows if r["count"]]
    assert [(r.day_name, r.hour, r.positive) for r in hit] == [("Mon", 5, 1)]


def test_kpi(spark):
    df = preds(spark, [{"ProductId": p, "inserted_at": T0 - dt.timedelta(seconds=s)}
                       for p, s in [("a", 0), ("a", 30), ("b", 61), (None, 120)]])
    r = distribution.kpi(df, T0, f1_score=0.8274).first()
    assert (r.totalPredictions, r.uniqueProducts, r.throughput, r.f1Score) == (4, 2, 0.03, 82.74)


def test_serialise(spark):
    df = spark.createDataFrame([(5, dt.datetime(2024, 1, 2, 3, 4, 5, 6), "x")], "Id long, inserted_at timestamp, s string")
    r = feed.serialise(df).first()
    assert (r.Id, r.inserted_at, r.s) == ("5", "2024-01-02T03:04:05.000006", "x")


def test_text_preview_and_filters(spark):
    df = preds(spark, [{"Id": 1, "Text": "x" * 101, "sentiment_label": "neutral", "ProductId": "p"},
                       {"Id": 2, "Text": "short", "sentiment_label": "negative", "ProductId": "q"}])
    got = [r[0] for r in df.orderBy("Id").select(feed.text_preview("Text")).collect()]
    assert got == ["x" * 100 + "…", "short"]
    assert feed.by_sentiments(df, ["negative"]).count() == 1 and feed.by_product(df, "p").count() == 1
    assert feed.by_sentiment(df, "all").count() == 2 and feed.by_sentiment(df, "").count() == 2


def test_lemmatize_with_dictionary(spark):
    from revlens.operators import lemmas as L
    rows = [(1, "geese running boxes"), (2, ""), (3, None), (None, "good movies"), (None, "bad movies"), (7, "nice"),
            (7, "sizes"), (8, "good movies")]
    docs = spark.createDataFrame(rows, "Id long, cleaned string")
    dic = spark.createDataFrame([("running", "run"), ("geese", "goose"), ("movies", "film"), (None, "x")],
                                "form string, lemma string")
    got = sorted((r.Id or 0, r.cleaned) for r in L.lemmatize_with(docs, dic).collect())
    assert got == [(0, "bad film"), (0, "good film"), (1, "goose run box"), (2, ""), (3, ""), (7, "nice"), (7, "size"),
                   (8, "good film")]


def test_lemma_pairs(spark):
    from revlens.functions.text import clean_text, lemma
    pairs = {"calories": "calorie", "movies": "movie", "brownies": "brownie", "berries": "berry", "sizes": "size",
             "prizes": "prize", "headaches": "headache", "peaches": "peach", "matches": "match", "lenses": "lens",
             "buses": "bus", "boxes": "box", "glasses": "glass", "dishes": "dish", "dogs": "dog", "this": "this"}
    df = spark.createDataFrame([(k,) for k in pairs], "w string")
    assert {r[0]: r[1] for r in df.select("w", lemma(F.col("w"))).collect()} == pairs
    assert df.select(clean_text(F.lit("Great movies"), lemmatise=False)).first()[0] == "great movies"


def test_draws_of_different_purposes_are_independent(spark):
    from revlens.functions.hashing import unit_hash
    from revlens.plans.training import with_folds
    df = spark.range(1, 60001).select(F.col("id").alias("Id"))
    u = [unit_hash("Id", 42, p).alias(p) for p in ("split", "undersample", "fold", "sample", "example")]
    names = ("split", "undersample", "fold", "sample", "example")
    c = df.select(*u).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a in names for b in names if a < b]).first()
    assert all(abs(x) < 0.02 for x in c)
    k = F.col("Id") % 100   # the corpus's mix: 14 negative, 8 neutral, 78 positive
    mixed = df.withColumn("sentiment", F.when(k < 14, 0).when(k < 22, 1).otherwise(2))
    train = prep.stratified_split(mixed).filter("split = 'train'")
    kept = prep.undersample_majority(train)
    n = {r[0]: r[1] for r in kept.groupBy("sentiment").count().collect()}
    assert abs(n[2] / (3 * n[1]) - 1) < 0.04
    sizes = {(r.fold, r.sentiment): r["count"] for r in with_folds(kept).groupBy("fold", "sentiment").count().collect()}
    assert len(sizes) == 9
    per = [sum(v for (f, _), v in sizes.items() if f == k) for k in range(3)]
    assert max(per) / min(per) < 1.06


def test_cast_label_and_drop_unusable(spark):
    df = spark.createDataFrame([("1", "a b"), ("x", "c"), (None, "d"), ("2", ""), ("0", None)],
                               "sentiment string, cleaned string")
    got = [tuple(r) for r in prep.drop_unusable(prep.cast_label(df)).collect()]
    assert got == [(1, "a b")]


def test_hot_product_is_aggregated_before_the_shuffle(spark):
    """A product holding a third of all rows: counts are combined per task before the
    exchange, so the hot key sends one row per task, and the result is exact."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("ProductId"),
        F.lit("positive").alias("sentiment_label"), F.col("id").alias("Id"))
    top = products.top_products(df, "positive", 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan
    rows = top.collect()
    assert rows[0].id == "hot" and rows[0]["count"] == n // 3
    k = distribution.kpi(df.withColumn("inserted_at", F.lit(T0)), now=T0).first()
    assert k.uniqueProducts == 1 + n - n // 3


def test_trend_empty_label_is_neutral(spark):
    t = 1262304000
    df = preds(spark, [{"Time": t, "sentiment_label": ""}, {"Time": t, "sentiment_label": None}])
    assert [tuple(r) for r in trends.yearly_trend(df).collect()] == [("2010", 0, 2, 0)]


def test_trends_use_repaired_millisecond_times(spark):
    """A millisecond Time is repaired once and then counts in the trends too."""
    df = preds(spark, [{"Time": 1303862400000, "sentiment_label": "positive"},   # 2011-04-27 in ms
                       {"Time": 1303862400, "sentiment_label": "negative"},
                       {"Time": 4000000001, "sentiment_label": "negative"}])       # ms, but before 1995
    assert [tuple(r) for r in trends.yearly_trend(df).collect()] == [("2011", 1, 0, 1)]
    apr = trends.monthly_trend(df, 2011).collect()[3]
    assert (apr.month, apr.positive, apr.negative) == ("Apr", 1, 1)


def test_product_page_counts_equals_separate_queries(spark):
    t = 1262304000
    df = preds(spark, [{"ProductId": "p", "Time": t, "sentiment_label": None},
                       {"ProductId": "p", "Time": t, "sentiment_label": "positive"},
                       {"ProductId": "p", "Time": 5, "sentiment_label": "negative"},      # unusable time
                       {"ProductId": "p", "Time": t + 400 * 86400, "sentiment_label": "neutral"},
                       {"ProductId": "q", "Time": t, "sentiment_label": "positive"}])
    rows = {(r.level, r.year): (r.totalReviews, r.positive, r.neutral, r.negative)
            for r in products.product_page_counts(df, "p").collect()}
    s = products.product_summary(df, "p").first()
    assert rows[("total", None)] == (s.totalReviews, s.positive, s.neutral, s.negative) == (4, 1, 1, 1)
    yearly = {r.year: (r.positive, r.neutral, r.negative) for r in products.product_yearly(df, "p").collect()}
    assert {y: v[1:] for (lvl, y), v in rows.items() if lvl == "year"} == yearly == {"2010": (1, 1, 0), "2011": (0, 1, 0)}
    assert products.product_page_counts(df, "none").count() == 0


def test_stratified_split_exact_sizes(spark):
    import math
    df = spark.range(0, 5003).select(F.col("id").alias("Id"),
                                     F.when(F.col("id") % 10 < 7, 2).when(F.col("id") % 10 < 9, 0).otherwise(1)
                                     .alias("sentiment"))
    out = prep.stratified_split_exact(df, buckets=64).cache()
    got = {(r.sentiment, r.split): r["count"] for r in out.groupBy("sentiment", "split").count().collect()}
    for c in (0, 1, 2):
        n = df.filter(F.col("sentiment") == c).count()
        rest = math.ceil(n * 20 / 100)
        test = math.ceil(rest * 10 / 20)
        assert (got[(c, "train")], got[(c, "val")], got[(c, "test")]) == (n - rest, rest - test, test)
    assert out.select("Id").distinct().count() == 5003
    # the same rows whatever the number of range partitions
    other = prep.stratified_split_exact(df, buckets=7)
    assert out.join(other, ["Id", "sentiment", "split"]).count() == 5003


def test_throughput_windows_equal_spark_sliding_windows(spark):
    """Bucket-then-spread gives exactly the windows of F.window(ts, 60 s, 10 s),
    including exact bucket edges, sub-second times and times before 1970."""
    import random
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(microseconds=rnd.randrange(0, 3_600_000_000)) for _ in range(500)]
    times += [base, base + dt.timedelta(seconds=10), dt.datetime(1969, 12, 31, 23, 59, 55), None]
    df = spark.createDataFrame([(t,) for t in times], "inserted_at timestamp")
    ours = {(r.window_start, r.window_end, r.n) for r in trends.throughput_windows(df).collect()}
    w = F.window("inserted_at", "60 seconds", "10 seconds")
    ref = {(r.s, r.e, r.n) for r in df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
           .select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n").collect()}
    assert ours == ref
    # A width that is not a multiple of the slide falls back to F.window itself.
    assert trends.throughput_windows(df, width="25 seconds").count() > 0


def test_search_pattern_valid_only_in_python_is_searched_literally(spark):
    """T18 in Spark's own regex dialect: a Python-only construct (named group
    ``(?P<x>...)``) would fail the job in Java, so it is searched as text."""
    df = preds(spark, [{"Id": 1, "Summary": "tea", "Text": "x"},
                       {"Id": 2, "Summary": "(?P<x>tea)", "Text": None}])
    assert [r.Id for r in feed.search(df, "(?P<x>tea)").collect()] == [2]
    assert [r.Id for r in feed.search(df, "^t[e]a$").collect()] == [1]   # valid patterns stay regexes


def test_newest_rows_equal_full_sort_with_ties_and_nulls(spark):
    """The cutoff step changes no result: ties at the cutoff, NULL times when fewer
    than k rows have one, and k larger than the table all match a full sort."""
    rows = [{"Id": i, "inserted_at": (T0 + dt.timedelta(seconds=i // 3)) if i % 5 else None} for i in range(40)]
    df = preds(spark, rows)

    def brute(frame, k):
        return [r.Id for r in frame.orderBy(F.desc_nulls_last("inserted_at"), F.desc("Id")).limit(k).collect()]

    for k in (1, 3, 7, 31, 32, 33, 50):
        assert [r.Id for r in feed.newest_rows(df, k).collect()] == brute(df, k), k
    only_nulls = preds(spark, [{"Id": i} for i in range(5)])
    assert [r.Id for r in feed.newest_rows(only_nulls, 3).collect()] == [4, 3, 2]


def test_after_cursor_equals_full_sort(spark):
    """The id cutoff changes no result: with and without a cursor, NULL ids, short tails."""
    # One NULL id only: the order among several NULL ids is a tie (any order is right).
    rows = [{"Id": i if i != 7 else None, "Summary": str(i)} for i in range(60)]
    df = preds(spark, rows)

    def brute(cursor, k):
        f = df if cursor is None else df.filter(F.col("Id") > cursor)
        return [(r.Id, r.Summary) for r in f.orderBy(F.asc("Id")).limit(k).collect()]

    def brute_newest(cursor, k):
        f = df if cursor is None else df.filter(F.col("Id") > cursor)
        return [(r.Id, r.Summary) for r in f.orderBy(F.desc("Id")).limit(k).collect()]

    for cursor in (None, 0, 10, 50, 58, 100):
        for k in (1, 5, 20):
            got = [(r.Id, r.Summary) for r in feed.after_cursor(df, cursor, k).collect()]
            assert got == brute(cursor, k), (cursor, k)
            newest = [(r.Id, r.Summary) for r in feed.after_cursor(df, cursor, k, newest_first=True).collect()]
            assert newest == brute_newest(cursor, k), (cursor, k, "newest")


def test_newest_rows_pages_on_numeric_time_equal_full_sort(spark):
    """Pages (offset + limit) by a numeric Time with ties and NULL times match a full sort."""
    rows = [{"Id": i, "Time": (1300000000 + i // 4) if i % 6 else None} for i in range(45)]
    df = preds(spark, rows)
    full = [r.Id for r in df.orderBy(F.desc_nulls_last("Time"), F.desc("Id")).collect()]
    for size in (1, 5, 20):
        for offset in (0, 5, 20, 35, 40, 60):
            got = [r.Id for r in feed.newest_rows(df, size, "Time", offset=offset).collect()]
            assert got == full[offset:offset + size], (size, offset)


def test_csv_keeps_empty_and_null_apart(spark, scratch):
    import os
    from revlens.schemas import RAW_REVIEW
    from revlens.sources import files
    rows = [(1, None, "", None, None, None, None, None, "", " a\n\"b\""), (2, "p", None, None, None, None, 3, 4, None, None)]
    df = spark.createDataFrame(rows, RAW_REVIEW)
    path = os.path.join(scratch, "csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_reviews_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))
    with open(os.path.join(scratch, "plain.csv"), "w") as f:   # a foreign file: an unquoted empty field is NULL
        f.write(",".join(RAW_REVIEW.names) + "\n1,,x,,,,,,\"\",t\n")
    got = files.read_reviews_csv(spark, os.path.join(scratch, "plain.csv")).first()
    assert got[1] is None and got[8] == "" and got[9] == "t"


def test_product_comparison_without_the_product(spark):
    from revlens.operators import distribution
    df = spark.createDataFrame([("a", "negative"), (None, "positive"), ("b", None)], "ProductId string, sentiment_label string")
    got = {r.label: (r.product_n, r.product_pct, r.global_n, r.global_pct) for r in distribution.product_vs_global(df, "z").collect()}
    assert got == {"negative": (0, 0.0, 1, 50.0), "neutral": (0, 0.0, 0, 0.0), "positive": (0, 0.0, 1, 50.0)}


def test_event_snapshots_far_off_event_and_no_events(spark):
    from revlens.operators import quality
    df = spark.sql("select cast(ts as timestamp) as ts from values ('2024-01-01 00:01:00'), ('2024-01-03 00:01:00'), (null) v(ts)")
    got = quality.event_snapshots(df)
    assert got.count() == 2 * 288 + 1 and got.agg(F.max("total"), F.min("total")).first()[:] == (2, 1)
    assert quality.event_snapshots(df.filter("ts is null")).count() == 0
    checks = {r.check: r.status for r in quality.table_checks(
        spark.createDataFrame([], "inserted_at timestamp, sentiment_label string")).collect()}
    assert checks == {"stats_freshness": "skip", "pipeline_latency": "skip", "sentiment_balance": "skip"}
