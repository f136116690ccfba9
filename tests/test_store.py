"""The table of record: replays, dead writers, two writers, compaction beside readers, rollups and id bitmaps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from revlens.operators import bitmaps, distribution, evaluation, products, rollup, trends
from revlens.schemas import PREDICTION
from revlens.sources import commits
from revlens.sources.commits import CommitList, Conflict
from revlens.sources.store import PredictionStore, start_store_query

DAY0 = dt.datetime(2024, 3, 1, 12)


def row(i, product="p", label="positive", day=0, conf=0.7, time=1709290000, pred=2.0):
    return (i, product, f"u{i}", time, f"s{i}", f"text {i}", f"text {i}", 2, pred, label, conf, DAY0 + dt.timedelta(days=day))


def frame(spark, rows):
    return spark.createDataFrame(rows, PREDICTION)


ODD = [row(1), row(1), row(2, None), row(3, "", ""), row(4, "q", None, 1, None), row(5, "q", "weird", 1, float("nan")),
       row(None, "é", "negative", 2, 1.0, None), row(7, "p", "neutral", 2, 0.549999, 4000000001), row(8, "p", "negative", 0, 0.55, 1303862400000),
       row(9, "p" * 3000, "positive", 40, 0.95, 5, None)]


@pytest.fixture()
def store(spark, scratch):
    return PredictionStore(spark, os.path.join(scratch, "store"), lanes=4, fan=2)


def ids(df):
    return sorted((r.Id for r in df.collect()), key=lambda i: (i is None, i))


def assert_equal_to_scan(store, rows):
    """Every rollup query equals its full-scan form over the stored rows, and opens rollup files only."""
    parts = store.counts()
    assert all(f"/{kind}/" not in f for f in parts.inputFiles() for kind in ("rows", "ids", "bitmaps"))
    pairs = [(rollup.global_distribution(parts), distribution.global_distribution(rows)),
             (rollup.yearly_trend(parts), trends.yearly_trend(rows)),
             (rollup.monthly_trend(parts, 2024), trends.monthly_trend(rows, 2024)),
             (rollup.top_products(parts), products.top_products(rows)),
             (rollup.top_products(parts, "negative", 3), products.top_products(rows, "negative", 3)),
             (rollup.confidence_histogram(parts), evaluation.confidence_histogram(rows))]
    for got, want in pairs:
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert rollup.total(parts).first()[0] == rows.count()
    assert bitmaps.distinct_count(store.id_bitmaps()).first()[0] == rows.select("ProductId").distinct().dropna().count()


def test_odd_rows_replays_and_merging_keep_counts_right(spark, store):
    assert store.append(frame(spark, ODD[:4]), "a", 0) == 4
    assert store.append(frame(spark, ODD[:4]), "a", 0) == 0  # a replay
    assert store.append(frame(spark, ODD[4:7]), "b", 0) == 3
    assert store.append(frame(spark, []), "a", 1) == 0  # an empty batch
    assert store.append(frame(spark, ODD[7:]), "a", 2) == 3
    assert_equal_to_scan(store, frame(spark, ODD))
    store.compact("2025-01-01")
    assert_equal_to_scan(store, frame(spark, ODD))
    assert ids(store.predictions()) == ids(frame(spark, ODD))
    assert ids(store.predictions(1)) == ids(frame(spark, ODD[:4]))  # an older version


def test_a_compaction_task_sorts_a_bounded_part_of_the_rows(spark, store, monkeypatch):
    """Many like rows are few bytes when stored: the ranges go by what the rows hold unpacked."""
    monkeypatch.setattr("revlens.sources.store.SORT_BYTES", 200_000, raising=False)
    store.append(frame(spark, [row(i, f"p{i % 3}") for i in range(4000)]), "a", 0)
    assert store.compact("2025-01-01") == {"rows": 1}
    files = store.predictions().inputFiles()
    sizes = [spark.read.parquet(f).count() for f in files]
    assert sum(sizes) == 4000 and len(files) >= 4 and max(sizes) <= 2000
    assert ids(store.predictions()) == list(range(4000))


def test_an_empty_table_answers(spark, store):
    assert store.version() == 0 and store.predictions().count() == 0
    assert_equal_to_scan(store, frame(spark, []))
    assert store.compact("2025-01-01") == {}


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, store):
    store.append(frame(spark, ODD[:2]), "a", 0)
    store._write_rows(frame(spark, ODD[2:]))
    assert store.predictions().count() == 2
    assert store.append(frame(spark, ODD[2:]), "a", 1) == len(ODD) - 2  # its retry
    assert_equal_to_scan(store, frame(spark, ODD))
    assert store.vacuum(older_than_s=-1) == 1
    assert_equal_to_scan(store, frame(spark, ODD))


def test_two_writers_that_meet_number_every_id_once(spark, store):
    """The second writer read the table before the first committed: it takes the next version and numbers again."""
    other = PredictionStore(spark, store.path, lanes=4)
    stale = other.log.state()
    assert store.append(frame(spark, [row(i, f"p{i % 5}") for i in range(20)]), "a", 0) == 20
    other.log.state = lambda version=None, once=[stale], real=other.log.state: once.pop() if once and version is None else real(version)
    assert other.append(frame(spark, [row(100 + i, f"p{i}") for i in range(8)]), "b", 0) == 8
    assert store.version() == 2
    numbers = store._read(store.log.state(), "ids", bitmaps.IDS)
    assert numbers.select("number").distinct().count() == numbers.count() == 8
    assert bitmaps.distinct_count(store.id_bitmaps()).first()[0] == 8
    assert store.predictions().count() == 28


def test_a_reader_is_not_disturbed_by_compaction(spark, store):
    for b in range(4):
        store.append(frame(spark, [row(10 * b + i, f"p{i}", day=i % 3) for i in range(10)]), "a", b)
    opened = store.predictions()
    assert store.compact("2024-03-03")["rows"] == 8  # two closed days of four batches
    assert opened.count() == store.predictions().count() == 40
    day = store.predictions(first_day="2024-03-02", last_day="2024-03-02")
    assert {str(r.d) for r in day.select(F.to_date("inserted_at").alias("d")).distinct().collect()} == {"2024-03-02"}
    assert all("ingest_date=2024-03-02" in f for f in day.inputFiles())
    assert len(day.inputFiles()) == 1  # one file instead of four
    assert "rows" not in store.compact("2024-03-03")  # nothing is written twice
    assert store.vacuum(older_than_s=-1) > 0
    assert store.predictions().count() == 40


def test_late_batches_keep_the_files_of_a_day_bounded(spark, store):
    for b in range(6):
        store.append(frame(spark, [row(b)]), "a", b)
        store.compact("2024-04-01")
        state = store.log.state()
        assert len(state.of("rows")) <= 2
        assert all(len(state.of(kind)) <= 4 for kind in ("rollup", "bitmaps", "ids"))
    assert_equal_to_scan(store, frame(spark, [row(b) for b in range(6)]))


def test_of_two_compactions_one_gives_way(spark, store):
    for b in range(2):
        store.append(frame(spark, [row(b)]), "a", b)
    old, stale = store.log.state().of("rows"), store.log.state()
    store.compact("2024-04-01")
    with pytest.raises(Conflict):
        store.log.commit({"remove": [f["path"] for f in old], "add": []}, stale)
    with pytest.raises(Conflict):
        store.log.commit({"remove": [f["path"] for f in old], "add": []}, store.log.state())
    assert store._replace(old, lambda: []) == 0
    assert store.predictions().count() == 2


def test_written_states_equal_a_replay_of_all_commits(spark, scratch, monkeypatch):
    monkeypatch.setattr(commits, "STATE_EVERY", 3)
    log = CommitList(spark, os.path.join(scratch, "log"))
    state = log.state()
    for n in range(8):
        state = log.commit({"add": [{"path": f"rows/{n}", "kind": "rows"}], "remove": [f"rows/{n - 2}"] if n > 1 else [],
                            "run": "r", "batch": n}, state)
    assert log._versions("states") == [3, 6]
    held = log.state()
    assert (held.version, held.runs, sorted(held.folders)) == (8, {"r": 7}, ["rows/6", "rows/7"])
    assert sorted(log.state(2).folders) == ["rows/0", "rows/1"]
    for v in range(1, 7):
        log.files.delete(log._commit_path(v))  # what a written state covers is not needed again
    assert log.state().folders == held.folders


def test_numbers_are_dense_in_their_lanes_and_stable(spark):
    none = spark.createDataFrame([], bitmaps.IDS)
    first = bitmaps.new_numbers(spark.createDataFrame([(f"p{i}",) for i in range(500)] * 2 + [(None,)], "id string"), none, lanes=4).cache()
    assert first.count() == 500 == first.select("number").distinct().count()
    per_lane = first.groupBy("lane").agg(F.count("*").alias("n"), (F.max("number") - F.min("number") + 1).alias("span")).collect()
    assert all(r.n == r.span for r in per_lane)
    more = bitmaps.new_numbers(spark.createDataFrame([(f"p{i}",) for i in range(400, 900)], "id string"), first, lanes=4)
    assert more.count() == 400 and more.join(first, "number").count() == 0


def test_the_stream_sink_goes_on_after_a_restart(spark, store, scratch):
    inbox, checkpoint = os.path.join(scratch, "in"), os.path.join(scratch, "ckpt")
    for b in range(3):
        frame(spark, [row(10 * b + i) for i in range(5)]).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", 1).parquet(inbox).drop("inserted_at")
        start_store_query(stream, store, checkpoint, available_now=True).awaitTermination()
    stored = store.predictions()
    assert stored.count() == 15 and stored.filter("inserted_at is null").count() == 0
    assert rollup.total(store.counts()).first()[0] == 15


def test_latest_rows_equal_complete_mode_after_each_batch(spark, scratch):
    """A batch writes changed keys only; replays count once; merged parts and old folders go."""
    from revlens.sources.latest import LatestTable, start_latest_query

    inbox = os.path.join(scratch, "in")
    written, table = [], None
    for b in range(5):
        rows = [(f"k{i % (b + 2)}", i) for i in range(b * 3 + 1)] + [(None, 1)] * (b % 2)
        written += rows
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(inbox)
        counts = stream.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        table = table or LatestTable(spark, os.path.join(scratch, "t"), ["k"], counts.schema, fan=2)
        start_latest_query(counts, table, os.path.join(scratch, "c"), available_now=True).awaitTermination()
        want = spark.createDataFrame(written, "k string, v int").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert len(table.log.state().of("changes")) <= 3
    run = next(iter(table.log.state().runs))
    assert not table.put(spark.createDataFrame([("k0", 99, 99)], "k string, n long, total long"), run, 2)  # a replay
    before = sorted(map(tuple, table.read().collect()), key=repr)
    assert table.vacuum(older_than_s=-1) > 0
    assert sorted(map(tuple, table.read().collect()), key=repr) == before
    assert LatestTable(spark, os.path.join(scratch, "none"), ["k"], counts.schema).read().count() == 0
