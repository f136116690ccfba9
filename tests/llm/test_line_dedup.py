"""Reversible line dedup: brute force, insert and delete, the cuckoo filter, odd rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revlens.llm import line_dedup
from revlens.llm.line_dedup import CuckooFilter, LineStore, dedup_lines

DOCS = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(WHITE).translate(ASCII_LOWER)


def brute(counted, cleaned, threshold, least=1):
    """Expected (doc_id, n_lines, n_dropped, kept) rows of ``cleaned`` with ``counted`` in the store."""
    holders = defaultdict(set)
    for i, text in counted:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= max(least, 1):
                holders[key_of(line)].add(i)
    rows = []
    for i, text in cleaned:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key_of(x)]) < threshold]
        rows.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(rows, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()], key=repr)


def corpus(rng, n, first=0):
    common = ["Home | About", "all rights reserved", "\tAll Rights Reserved ", "É accent", "x", " "]
    return [(first + i, "\n".join(rng.choice(common) if rng.random() < .5 else f"own {rng.randrange(60)}"
                                  for _ in range(rng.randrange(1, 9)))) for i in range(n)]


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "same\nsame\nsame"), (5, "SAME \n\x0bsame"), (5, "same"), (6, "same\r\nother\r"),
       (None, "same\nsame"), (None, None), (7, "é same \nsame"), (8, "a\x00b\nsame"), (9, "line\n" * 20_000 + "same"), (7, "z")]


def test_equals_brute_force(spark):
    rows = corpus(random.Random(1), 60) + corpus(random.Random(2), 10, 30)
    for threshold, least in ((10, 1), (3, 1), (3, 4)):
        frame = spark.createDataFrame(rows, DOCS)
        assert got(dedup_lines(frame, threshold, least)) == brute(rows, rows, threshold, least)


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    frame = spark.createDataFrame(ODD, DOCS)
    for c in ("id", "key", "text_key", "pos", "gone", "salt", "kept", "n_lines", "n_dropped", "shard", "blob", "docs", "lines"):
        frame = frame.withColumn(c, F.lit("clash"))
    found = dedup_lines(frame, threshold=4)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert got(found) == brute(ODD, ODD, 4)
    none = spark.createDataFrame([], DOCS)
    assert got(dedup_lines(none)) == []
    store = LineStore.create(spark, threshold=2).insert(none)
    assert got(store.clean(frame)) == brute([], ODD, 2)


def test_insert_and_delete_are_reversible(spark):
    rng = random.Random(5)
    first, second, third = corpus(rng, 40), corpus(rng, 30, 40), corpus(rng, 30, 70)
    frames = [spark.createDataFrame(rows, DOCS) for rows in (first, second, third)]
    store = one = LineStore.create(spark, threshold=6, shard_keys=8).insert(frames[0])
    kept = [got(one.clean(frames[0]))]
    for frame in frames[1:]:
        store = store.insert(frame)
    everything = first + second + third
    assert store.shards > 1
    assert got(store.clean(frames[2])) == brute(everything, third, 6)
    assert store.insert(frames[1]).counts().exceptAll(store.counts()).count() == 0  # held already: nothing changes
    less = store.delete(frames[1].select("doc_id"))
    assert got(less.clean(frames[0])) == brute(first + third, first, 6)
    back = less.delete(frames[2].select("doc_id").union(spark.createDataFrame([(999,), (None,)], "doc_id long")))
    kept.append(got(back.clean(frames[0])))
    assert kept[0] == kept[1] == brute(first, first, 6)
    assert sorted(map(tuple, back.counts().collect())) == sorted(map(tuple, one.counts().collect()))
    again = back.insert(frames[1])  # a deleted document comes in again
    assert got(again.clean(frames[1])) == brute(first + second, second, 6)
    assert got(one.clean(frames[0])) == kept[0]  # an older version stays readable
    gone = again.delete(spark.createDataFrame(first + second, DOCS).select("doc_id"))
    assert gone.counts().count() == 0
    assert got(gone.clean(frames[0])) == brute([], first, 6)


def test_filters_hold_exactly_the_common_keys(spark):
    rows = corpus(random.Random(7), 80)
    store = LineStore.create(spark, threshold=5, shard_keys=4).insert(spark.createDataFrame(rows[:30], DOCS))
    store = store.insert(spark.createDataFrame(rows[30:], DOCS)).delete(spark.createDataFrame([(i,) for i in range(20, 60)], "doc_id long"))
    common = [r.key for r in store.counts().filter("docs >= 5").collect()]
    rare = [r.key for r in store.counts().filter("docs < 5").collect()]
    held = [CuckooFilter.of_bytes(r.blob) for r in store.filters().collect()]
    assert all(any(f.has([bytes(k)])[0] for f in held) for k in common)
    assert not any(any(f.has([bytes(k)])[0] for f in held) for k in rare)  # taken out again, not only unused
    assert sum(int((f.table != 0).sum()) for f in held) == len(common)


def test_cuckoo_filter_add_has_remove():
    rng = random.Random(9)
    keys = [rng.randbytes(16) for _ in range(3000)]
    held = CuckooFilter.sized(len(keys))
    assert all(held.add(k) for k in keys)
    assert held.has(keys).all()
    others = [rng.randbytes(16) for _ in range(3000)]
    assert held.has(others).sum() <= 1
    assert CuckooFilter.of_bytes(held.to_bytes()).has(keys).all()
    assert all(held.remove(k) for k in keys[:1500])
    assert held.has(keys[1500:]).all() and held.has(keys[:1500]).sum() <= 1
    small = CuckooFilter(1)
    assert [small.add(k) for k in keys[:5]] == [True] * 4 + [False]  # full: unchanged
    assert small.has(keys[:4]).all()
    assert not small.remove(keys[4])


def test_a_filter_that_is_full_is_made_anew(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 2 * 40, i % 2 * 40 + 40))) for i in range(20)]
    store = LineStore.create(spark, threshold=10, shard_keys=1 << 16).insert(spark.createDataFrame(rows[::2], DOCS))
    small = store.filters().collect()
    assert len(small) == 1
    store = store.insert(spark.createDataFrame(rows[1::2], DOCS))
    assert got(store.clean(spark.createDataFrame(rows, DOCS))) == brute(rows, rows, 10)
    assert len(store.filters().first().blob) > len(small[0].blob)


@pytest.mark.parametrize("text,least,want", [
    (" AÀb\t", 1, ["aÀb"]), ("\u00a0a", 1, ["\u00a0a"]), ("\x0b \x0c", 1, [None]), ("", 1, [None]), (None, 1, [None]),
    ("ééé\nx\r\nLong Line", 3, ["ééé", None, "long line"]), ("a\n", 0, ["a", None])])
def test_line_keys(text, least, want):
    assert line_dedup.line_keys(text, least) == [w and hashlib.md5(w.encode()).digest() for w in want]
