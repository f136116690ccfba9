"""Trigram search: equal to the full scan for literals, regexes, letters beyond ASCII and odd rows; and what it reads."""

import os
import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import feed, textindex

SCHEMA = "Id long, ProductId string, Summary string, Text string"
SYLLABLES = ["wor", "th", "less", "ío", "CIÓN", "straße", "ſt", "K", "σας", "ΣΑ", "İx", "ı", " ", ".", "a", "ab", "😀", "\n", "\\"]


def corpus(rng, n):
    rows = [(i, f"p{i % 7}", "".join(rng.choices(SYLLABLES, k=rng.randrange(4))), "".join(rng.choices(SYLLABLES, k=rng.randrange(9))))
            for i in range(n)]
    return rows + [(None, "p", "worthless", None), (None, "p", None, "no id worthless"), (3, "p", "again worthless", ""),
                   (n, None, None, None), (n + 1, "p", "", ""), (n + 2, "p", "x", "long " * 20_000 + "worthless"), (2 ** 50, "p", "worthless", "")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("textindex"))
    frame = spark.createDataFrame(corpus(random.Random(4), 3000), SCHEMA)
    frame.repartitionByRange(30, "Id").sortWithinPartitions("Id").write.parquet(os.path.join(root, "rows"))
    rows = spark.read.schema(SCHEMA).parquet(os.path.join(root, "rows"))
    # Written in two batches that share some rows, as a stream would after a retry.
    textindex.write_index(rows.filter("Id < 2000 or Id is null"), os.path.join(root, "index"))
    textindex.write_index(rows.filter("Id >= 1900"), os.path.join(root, "index"))
    return rows, spark.read.schema(textindex.POSTINGS).parquet(os.path.join(root, "index"))


@pytest.mark.parametrize("q", ["worthless", "WORTHLESS", "ción", "straße", "STRASSE", "ST", "kab", "σΑΣ", "ix", "iab", "th less", "😀a",
                               "wor(th)?less", "less.*wor", "a+b+wor", "[ab]{2}less", "th|zzz", "^worthless$", "less\\.", "zzzzzz", "wo",
                               "(?P<bad>worthless", "th\\\\a", "\\bworthless", "less\nwor", "K", "ſt"])
def test_equal_to_the_full_scan(stored, q):
    rows, index = stored
    for literal in (False, True):
        for limit in (1, 20, 5000):
            got = [r.Id for r in textindex.search(rows, index, q, limit, literal).collect()]
            assert got == [r.Id for r in feed.search(rows, q, limit, literal).collect()], (q, literal, limit)


def test_empty_query_empty_table_and_empty_index(spark, stored):
    rows, index = stored
    assert textindex.search(rows, index, "").count() == 0 and textindex.search(rows, index, None).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert textindex.search(none, textindex.postings(none), "worthless").count() == 0


def test_more_candidates_than_the_chunks_hold(stored, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST_CHUNK", 2)
    monkeypatch.setattr(textindex, "LARGEST_CHUNK", 5)
    rows, index = stored
    for q in ("less.wor", "worth[^l]", "ab.ab"):
        got = [r.Id for r in textindex.search(rows, index, q, 20).collect()]
        assert got == [r.Id for r in feed.search(rows, q, 20).collect()]


def scanned_rows(df, path_part: str) -> int:
    """Rows that the scans of ``path_part`` gave when ``df`` was run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif "Scan" in name and path_part in str(node):
            total += node.metrics().apply("numOutputRows").value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_only_the_candidates_files_are_read(spark, tmp_path):
    """One rare word in 20 000 rows of 40 files: the page reads the file that holds it (and ids), not the table."""
    rows = [(i, "p", f"summary {i}", "needle in hay" if i == 7777 else f"common text {i % 50}") for i in range(20_000)]
    path, index = str(tmp_path / "rows"), str(tmp_path / "index")
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(40, "Id").sortWithinPartitions("Id").write.parquet(path)
    table = spark.read.schema(SCHEMA).parquet(path)
    textindex.write_index(table, index)
    postings = spark.read.schema(textindex.POSTINGS).parquet(index)
    page = textindex.search(table, postings, "needle", 20)
    assert [r.Id for r in page.collect()] == [7777]
    assert 0 < scanned_rows(page, "Text") <= 1000
    assert scanned_rows(feed.search(table, "needle", 20), "Text") == 20_000
    full = textindex.search(table, postings, "n.", 20)  # no run of three letters: the full scan, stated
    assert [r.Id for r in full.collect()] == [r.Id for r in feed.search(table, "n.", 20).collect()]


def test_fold_joins_what_a_case_blind_match_holds_equal(spark):
    pairs = set()
    for c in (chr(x) for x in range(1, 0x10000) if not 0xD800 <= x < 0xE000):
        pairs |= {(c, d) for d in (c.lower(), c.upper(), c.casefold(), c.title(), c.upper().lower(), c.lower().upper()) if len(d) == 1 and d != c}
    frame = spark.createDataFrame(sorted(pairs), "c string, d string").repartition(4)
    equal = frame.filter(F.expr(r"d rlike concat('(?iu)^\\Q', c, '\\E$')"))
    assert equal.count() > 2000
    assert equal.filter(textindex.fold(F.col("c")) != textindex.fold(F.col("d"))).collect() == []


@pytest.mark.parametrize("pattern,runs", [
    ("worthless", ["worthless"]), ("wor+th", ["wor", "th"]), ("a(bc)?def", ["a", "def"]), ("x[abc]yz.*foo\\.bar", ["x", "yz", "foo.bar"]),
    ("a|b", []), ("foo{2}bar", ["fo", "bar"]), ("^hello world$", ["hello world"]), ("\\bfoo\\b", ["foo"]), ("ab?cd", ["a", "cd"]),
    ("(?i)abc", []), ("[]a]bcd", ["bcd"]), ("[^]a]bcde", ["bcde"]), ("a\\Q.b", []), ("(a(bc)d)ef", ["ef"]), ("[a&&b]cde", []), ("abc*", ["ab"])])
def test_required_runs(pattern, runs):
    assert textindex.required_runs(pattern) == runs


@pytest.mark.parametrize("pairs", [1, 7, 1 << 21])
def test_postings_are_grouped_in_the_tasks(spark, monkeypatch, pairs):
    """The lists of ids, however few pairs a task groups at a time; letters of one to four bytes, NUL, NULL, repeated and negative ids."""
    monkeypatch.setattr(textindex, "PAIRS", pairs, raising=False)
    rows = [(1, "p", "Ab\x00c", "aB\x00c"), (1, "p", None, "ab\x00"), (-5, "p", "😀é中x", ""), (70_000, "p", "xx", "ab\x00"), (None, "p", "abc", "abc"),
            (9, None, None, None)]
    built = textindex.postings(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    got = {(r.gram, r.part): (r.n, r.ids) for r in built.collect()}
    assert got == {("ab\x00", 0): (1, [1]), ("b\x00c", 0): (1, [1]), ("😀é中", -1): (1, [-5]), ("é中x", -1): (1, [-5]), ("ab\x00", 1): (1, [70_000])}
    assert "explode" not in built._jdf.queryExecution().optimizedPlan().toString()


def test_alternatives_inside_a_group_leave_the_runs_around_it():
    assert textindex.required_runs("worth(l|L)?[a-z]ess") == ["worth", "ess"]
    assert textindex.required_runs("abc(d|(e|f)g)hij") == ["abc", "hij"]
    assert textindex.required_runs("abc(d)|efg") == textindex.required_runs("abc)|efg") == textindex.required_runs("a\\(b|c") == []
