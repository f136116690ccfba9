"""Search by an inverted index of letter trigrams (P17): the same rows as the full scan, without reading every text.

The index has one posting row per (trigram, range of ids): the ids whose case-folded
Summary or Text holds the trigram. A search takes the literal runs that every match of the
pattern must contain, reads the postings of their rarest trigrams, and matches the
pattern itself only against the rows of ids that hold them all, in id order, until
the page is full. A pattern without a run of three characters is searched by the full scan.

Case folding maps characters that a case-blind match holds equal to one form; it may join more
than that, which costs a candidate and never a match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators import feed

GRAM = 3
#: Ids in one posting row: a trigram of every row has postings in pieces, none of them unbounded.
ID_RANGE = 1 << 16
MOST_GRAMS = 4
FIRST_CHUNK, LARGEST_CHUNK = 64, 4096
POSTINGS = "gram string, part long, n int, ids array<long>"


# Characters whose upper case is that of another lower-case letter: a case-blind match holds them equal to it.
_TWINS = {c: c.upper().lower() for c in map(chr, range(0x80, 0xD800)) if len(c.upper()) == 1 and c.upper().lower() != c.lower()}
_TWINS |= {c: c.upper().lower() for c in map(chr, range(0xE000, 0x10000)) if len(c.upper()) == 1 and c.upper().lower() != c.lower()}


def _class(chars) -> str:
    """A regex class of characters, in ranges: hundreds of single ones would each be tried at every place of a text."""
    codes, ranges = sorted(map(ord, chars)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _if(test, x: Column, then) -> Column:
    """``then(x)`` where the test holds, else ``x``; ``x`` stands in an array of one, so that it is made once."""
    return F.element_at(F.transform(F.array(x), lambda v: F.when(test(v), then(v)).otherwise(v)), 1)


def fold(text: Column) -> Column:
    """One form for characters that differ by case only (and for some more).

    Characters are translated one by one, which few texts need: only those are that hold one of them.
    """
    twins = _TWINS | {"İ": "i"}
    beyond = f"[^\\x00-\\xff]|{_class(c for c in twins if ord(c) < 0x100)}"  # one look for all others
    any_twin = lambda t: t.rlike(beyond) & t.rlike(_class(twins))
    plain = _if(any_twin, text, lambda t: F.translate(t, "".join(twins), "".join(twins.values())))
    return F.replace(F.lower(plain), F.lit("ς"), F.lit("σ"))


def _grams(text: str) -> set[str]:
    """The distinct trigrams of a folded text."""
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


_SHIFTS = np.array([42, 21, 0], dtype=np.int64)  # a code point has 21 bits


def _gram_codes(text: str | None) -> np.ndarray:
    """The distinct trigrams of a folded text, each as one number of its three code points."""
    if not text or len(text) < GRAM:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def _gram_strings(codes: np.ndarray) -> pa.Array:
    points = ((codes[:, None] >> _SHIFTS) & 0x1FFFFF).astype("<u4")
    sizes = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))


#: (trigram, row) pairs that a task groups at a time.
PAIRS = 1 << 21
PIECE_ROWS = 10_000


def _pieces(batches):
    """Rows (Id, summary, text), folded -> pieces of postings: (gram, part, ids)."""
    ids, codes, held = [], [], 0

    def grouped():
        gram = np.concatenate(codes)
        row = np.repeat(np.array(ids, np.int64), [len(c) for c in codes])
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        part = row // ID_RANGE
        new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        ends = np.concatenate([new, [len(gram)]]).astype(np.int32)
        for at in range(0, len(new), PIECE_ROWS):
            some = new[at:at + PIECE_ROWS]
            edges = ends[at:at + PIECE_ROWS + 1]
            yield pa.RecordBatch.from_arrays(
                [_gram_strings(gram[some]), pa.array(part[some]),
                 pa.ListArray.from_arrays(pa.array(edges - edges[0]), pa.array(row[edges[0]:edges[-1]]))], ["gram", "part", "ids"])

    for batch in batches:
        for i, summary, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = _gram_codes(text)
            if summary:
                own = np.union1d(own, _gram_codes(summary))
            if len(own):
                ids.append(i)
                codes.append(own)
                held += len(own)
            if held >= PAIRS:
                yield from grouped()
                ids, codes, held = [], [], 0
    if held:
        yield from grouped()


def postings(rows: DataFrame) -> DataFrame:
    """``POSTINGS`` of rows with Id, Summary and Text. Rows without an id are not indexed: a search reads them all.

    A task groups the pairs (trigram, row) of its own rows, so that lists of ids are shuffled, not pairs.
    """
    held = rows.filter("Id is not null").select(F.col("Id").cast("long").alias("Id"), fold(F.coalesce("Summary", F.lit(""))).alias("summary"),
                                                fold(F.coalesce("Text", F.lit(""))).alias("text"))
    pieces = held.mapInArrow(_pieces, "gram string, part long, ids array<long>")
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return (pieces.groupBy("gram", "part").agg(ids.alias("ids")).select("gram", "part", F.size("ids").alias("n"), "ids"))


def write_index(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Add the postings of (new) rows to an index; sorted by trigram, so that a search opens the row groups of its own."""
    (postings(rows).repartitionByRange("gram", "part").sortWithinPartitions("gram", "part")
     .write.mode(mode).option("parquet.bloom.filter.enabled#gram", "true").parquet(path))


def required_runs(pattern: str) -> list[str]:
    """Literal runs that every match of a regex contains, by a cautious reading: what is in groups, classes or
    before ``? * {`` is left out; a pattern with alternatives outside of groups, quoting, inline flags or comments has none."""
    if any(x in pattern for x in ("(?", "\\Q", "\\E", "\\p", "\\P", "\\x", "\\u", "\\N", "\\c", "\\0", "\\k")):
        return []
    runs, run, i, depth = [], "", 0, 0

    def done():
        nonlocal run
        if run and depth == 0:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            literal = pattern[i:i + 1]
            if not literal or literal.isalnum():
                done()
            else:
                run += literal
        elif c in "*?{":
            run = run[:-1]
            done()
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return []
        elif c == "[":
            done()
            i += 2 if pattern[i + 1:i + 2] == "^" else 1
            i += pattern[i:i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "[" or pattern[i:i + 2] == "&&":
                    return []  # nested classes
                i += 2 if pattern[i] == "\\" else 1
            if i >= len(pattern):
                return []
        elif c == "|":
            if depth <= 0:
                return []
            done()
        elif c in "()":
            done()
            depth += 1 if c == "(" else -1
        elif c in ".^$+":
            done()
        else:
            run += c
        i += 1
    done()
    return runs


def query_grams(spark, runs: list[str]) -> list[str]:
    """The distinct trigrams of the runs, folded as the index is."""
    if not runs:
        return []
    folded = spark.range(1).select(F.array(*[fold(F.lit(r)) for r in runs])).first()[0]
    return sorted(set().union(*map(_grams, folded)))


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(Id) of the rows that hold the rarest (``MOST_GRAMS``) of the wanted trigrams; only their postings are read."""
    mine = index.filter(F.col("gram").isin(*wanted))
    sizes = {r["gram"]: r["n"] for r in mine.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row a wanted trigram
    if len(sizes) < len(wanted):
        return index.select(F.lit(None).cast("long").alias("Id")).limit(0)  # one of them is in no row
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:MOST_GRAMS]
    held = index.filter(F.col("gram").isin(*rarest)).select("gram", F.explode("ids").alias("Id"))
    # An index written in batches may hold an id twice.
    return (held.groupBy("Id").agg(F.collect_set("gram").alias("held")).filter(F.size("held") == len(rarest)).select("Id"))


def _matches(q: str, literal: bool, spark) -> Column:
    if literal:
        needle = F.lit(q.lower())
        return F.lower(F.coalesce("Summary", F.lit(""))).contains(needle) | F.lower(F.coalesce("Text", F.lit(""))).contains(needle)
    pattern = "(?iu)" + feed._safe_pattern(spark, q)
    return F.coalesce(F.col("Summary").rlike(pattern), F.lit(False)) | F.coalesce(F.col("Text").rlike(pattern), F.lit(False))


def search(df: DataFrame, index: DataFrame, q: str | None, limit: int = 20, literal: bool = False) -> DataFrame:
    """P17 by the index of ``df``: equal to ``feed.search``.

    Candidates are taken in id order in chunks (their ids reach the scan as a range and a list); after a
    few chunks without a full page the rest is matched in one distributed join.
    """
    spark = df.sparkSession
    if not q:
        return df.limit(0)
    wanted = query_grams(spark, [q] if literal else required_runs(feed._safe_pattern(spark, q)))
    if not wanted:
        return feed.search(df, q, limit, literal)
    hit = _matches(q, literal, spark)
    found = candidates(index, wanted)
    rare = found.orderBy("Id").limit(FIRST_CHUNK + LARGEST_CHUNK).collect()
    ids, matched = [r["Id"] for r in rare], []
    for chunk in (ids[:FIRST_CHUNK], ids[FIRST_CHUNK:]):
        if chunk and len(matched) < limit:
            rows = df.filter(F.col("Id").between(chunk[0], chunk[-1]) & F.col("Id").isin(*chunk)).filter(hit)
            matched += [r["Id"] for r in rows.select("Id").distinct().orderBy("Id").limit(limit).collect()]
    kept = F.col("Id").isNull()
    if matched:
        kept = kept | (F.col("Id").between(matched[0], matched[-1]) & F.col("Id").isin(*matched))
    page = df.filter(kept).filter(hit)
    if len(matched) < limit and len(ids) == FIRST_CHUNK + LARGEST_CHUNK:
        rest = found.filter(F.col("Id") > ids[-1])
        page = page.unionByName(df.filter(F.col("Id") > ids[-1]).join(rest, "Id", "left_semi").select(*df.columns).filter(hit))
    return page.orderBy("Id").limit(limit)
