"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A ``LineStore`` is a folder of written tables. Of every line key it holds the exact
number of documents with that line (``counts``), of every document its line
keys (``postings``, with tombstones in ``deleted``), and of the keys that at least
``threshold`` documents hold one cuckoo filter per shard (``filters``). Documents
are inserted and deleted in batches; each batch writes a new version and leaves the
older ones readable. A key enters its shard's filter when its count reaches the
threshold and leaves it when the count falls below, so deleting a batch gives back the
decisions of before.

``clean`` probes the shard filters with the distinct keys of the given documents (a
filter has no false negatives), verifies the hits against the exact
counts and drops the lines of the verified keys.

A key is the MD5 of a line stripped of ASCII white space, with A-Z lower-cased. Shards
follow the number of keys, so that neither a filter nor a task grows with the
table; lines and texts are never grouped by a hot key in one task: counts are
aggregated before the shuffle and the join back to the lines is salted.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require, text_of
from revlens.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_KEYS = 1 << 16
SLOTS = 4
KICKS = 500
LOAD = 0.85
SALTS = 16


class CuckooFilter:
    """Set of 128-bit keys with deletion: 32-bit fingerprints, two buckets of four slots each.

    ``add`` answers False when no place is found (the filter is then unchanged);
    ``remove`` takes out one copy of a key that was added.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint32)
        self.mask = np.uint64(buckets - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def of_bytes(cls, blob: bytes) -> CuckooFilter:
        made = cls(len(blob) // (4 * SLOTS))
        made.table = np.frombuffer(blob, dtype="<u4").reshape(-1, SLOTS).copy()
        return made

    def to_bytes(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of each key."""
        words = np.frombuffer(b"".join(keys), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        prints = (words[:, 0] >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        first = words[:, 1] & self.mask
        return prints, first, first ^ self.jump(prints)

    def jump(self, prints):
        """Distance between a fingerprint's two buckets; the same from either side."""
        return ((np.asarray(prints, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) & self.mask

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        prints, first, second = self.places(keys)
        want = prints[:, None]
        return ((self.table[first] == want) | (self.table[second] == want)).any(axis=1)

    def add(self, key: bytes) -> bool:
        (print_,), (first,), (second,) = self.places([key])
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        moved: list[tuple[int, int]] = []
        bucket = second
        for kick in range(KICKS):
            slot = (kick * 7 + int(print_)) % SLOTS
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
            moved.append((bucket, slot))
            bucket = bucket ^ self.jump(print_)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        for bucket, slot in reversed(moved):
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
        return False

    def remove(self, key: bytes) -> bool:
        (print_,), (first,), (second,) = self.places([key])
        for bucket in (first, second):
            held = np.flatnonzero(self.table[bucket] == print_)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False


_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_keys(text: str | None, least: int = 1) -> list[bytes | None]:
    """The key of every line of a text (NULL: one empty line); None for a line with fewer than ``least`` code
    points (at least one) after stripping."""
    keys = []
    for line in (text or "").encode().translate(_LOWER).split(b"\n"):
        bare = line.strip()  # of ASCII white space
        enough = bare and (len(bare) >= 4 * least or len(bare.decode()) >= least)
        keys.append(hashlib.md5(bare).digest() if enough else None)
    return keys


def line_keys_column(text: Column, least: int) -> Column:
    @F.pandas_udf("array<binary>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([line_keys(t, least) for t in texts], dtype=object)

    return keys(text)


def shard_of(key: str | Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (shard, blob, key, up) sorted by shard, a shard's blob (if any) first: one filter row per shard.

    A filter without place for all keys is returned empty and marked ``full``: it is made anew from the exact table.
    """
    shard = held = None
    full = False
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.shard != shard:
                if held is not None:
                    yield _filter_row(shard, held, full)
                shard, held, full = row.shard, CuckooFilter.sized(0), False
            if row.blob is not None:
                held = CuckooFilter.of_bytes(row.blob)
            elif row.up:
                full = not held.add(row.key) or full
            else:
                held.remove(row.key)
    if held is not None:
        yield _filter_row(shard, held, full)


def _filter_row(shard: int, held: CuckooFilter, full: bool) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "blob": [b"" if full else held.to_bytes()], "full": [full]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (shard, blob, key) sorted by shard, blobs first: the keys that their shard's filter may hold."""
    shard = held = None
    for batch in batches:
        ids = batch["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if ids[a] != shard:
                shard, held = ids[a], None
            part = batch.iloc[a:b]
            blobs = part["blob"].notna()
            if blobs.any():
                held = CuckooFilter.of_bytes(part.loc[blobs, "blob"].iloc[0])
            keys = part.loc[~blobs, "key"].tolist()
            if held is not None and keys:
                found = held.has(keys)
                if found.any():
                    yield pd.DataFrame({"key": [k for k, hit in zip(keys, found) if hit]})


def _without(text: Column, positions: Column) -> Column:
    """The text without the lines at the given positions."""
    def kept(whole, gone):
        if whole is None or gone is None:
            return None
        gone = set(gone)
        return "\n".join(line for i, line in enumerate(whole.split("\n")) if i not in gone)

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([kept(t, d) for t, d in zip(texts, dropped)], dtype=object)

    return without(text, positions)


@dataclass(frozen=True)
class LineStore:
    """One version of a store; ``insert`` and ``delete`` write the next and return it.

    ``threshold``: documents that must hold a line before it is dropped. ``least``: code
    points that a stripped line needs to be counted at all. Documents are told
    apart by id: rows of one id are one document, rows without an id are cleaned but not
    counted, an id that is already in the store is not inserted again, and
    deleting an unknown id does nothing.
    """

    spark: SparkSession
    path: str
    threshold: int = 10
    least: int = 1
    shard_keys: int = SHARD_KEYS
    version: int = 0
    shards: int = 1

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, **settings) -> LineStore:
        """An empty store in ``path`` (a new folder of the shared checkpoint folder by default)."""
        return cls(spark, path or os.path.join(checkpoint_dir(spark), f"llm-lines-{uuid.uuid4().hex}"), **settings)

    def _at(self, name: str, version: int | None = None) -> str:
        return os.path.join(self.path, name, f"version={self.version if version is None else version}")

    def _read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(name, version))

    def counts(self) -> DataFrame:
        """(key, docs): the exact number of documents of every line key in the store."""
        return self._read("counts", "key binary, docs long")

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, blob binary")

    def postings(self, id_type: str) -> DataFrame:
        """(id, key) of the documents in the store: inserted, and not deleted by a later version."""
        if not self.version:
            return self.spark.createDataFrame([], f"id {id_type}, key binary")
        rows = self.spark.createDataFrame([], f"id {id_type}, key binary, at int")
        gone = self.spark.createDataFrame([], f"id {id_type}, until int")
        for v in range(1, self.version + 1):
            rows = rows.union(self._read("postings", f"id {id_type}, key binary", v).withColumn("at", F.lit(v)))
            gone = gone.union(self._read("deleted", f"id {id_type}", v).withColumn("until", F.lit(v)))
        last = gone.groupBy("id").agg(F.max("until").alias("until"))
        return (rows.join(last, "id", "left").filter(F.col("until").isNull() | (F.col("until") < F.col("at")))
                .select("id", "key"))

    def lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, text_key, pos, key) of every line that is long enough; a NULL text is one empty line."""
        require(docs, id_col, text_col)
        text = text_of(text_col)
        return (docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("text_key"),
                            line_keys_column(text, self.least).alias("keys"))
                .select("id", "text_key", F.posexplode("keys").alias("pos", "key")).filter("key is not null"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The store with the documents added whose id it does not hold yet."""
        return self.insert_lines(self.lines(docs, id_col, text_col))

    def insert_lines(self, lines: DataFrame) -> LineStore:
        """``insert`` of documents whose ``lines`` are at hand."""
        id_type = dict(lines.dtypes)["id"]
        pairs = lines.filter("id is not null").select("id", "key").distinct()
        if self.version:
            pairs = pairs.join(self.postings(id_type).select("id").distinct(), "id", "left_anti")
        return self._next(pairs, self.spark.createDataFrame([], f"id {id_type}"), +1)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineStore:
        """The store without the documents of the given ids."""
        require(ids, id_col)
        id_type = dict(ids.dtypes)[id_col]
        gone = materialize(ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct(), "lines-gone")
        return self._next(self.postings(id_type).join(gone, "id", "left_semi"), gone, -1)

    def _next(self, pairs: DataFrame, gone: DataFrame, sign: int) -> LineStore:
        new = replace(self, version=self.version + 1)
        if sign > 0:
            pairs.write.mode("overwrite").parquet(new._at("postings"))
            pairs = self.spark.read.schema(pairs.schema).parquet(new._at("postings"))
        else:
            pairs = materialize(pairs, "lines-pairs")
            pairs.limit(0).write.mode("overwrite").parquet(new._at("postings"))
        gone.write.mode("overwrite").parquet(new._at("deleted"))
        change = pairs.groupBy("key").agg((F.count(F.lit(1)) * sign).alias("change"))
        merged = (self.counts().select("key", F.col("docs").alias("before"), F.lit(0).cast("long").alias("change"))
                  .union(change.select("key", F.lit(0).cast("long").alias("before"), "change"))
                  .groupBy("key").agg(F.sum("before").alias("before"), F.sum("change").alias("change")))
        after = merged.select("key", "before", (F.col("before") + F.col("change")).alias("docs"))
        after.write.mode("overwrite").parquet(new._at("merged"))
        after = self.spark.read.schema("key binary, before long, docs long").parquet(new._at("merged"))
        after.filter("docs > 0").select("key", "docs").write.mode("overwrite").parquet(new._at("counts"))
        return new._with_filters(after, self)

    def _with_filters(self, after: DataFrame, old: LineStore) -> LineStore:
        """Move the keys that crossed the threshold into or out of their shard's filter.

        The number of shards doubles with the number of keys; then, and where a
        filter has no place left, filters are made anew from the exact table.
        """
        keys, shards = self.counts().count(), old.shards
        while shards * self.shard_keys < keys:
            shards *= 2
        new = replace(self, shards=shards)
        common = self.counts().filter(F.col("docs") >= self.threshold).select("key")
        if shards != old.shards or not old.version:
            new._write_filters(new._fresh(common))
            return new
        was, now = F.col("before") >= self.threshold, F.col("docs") >= self.threshold
        moved = after.filter(was != now).select(shard_of("key", shards).alias("shard"), F.lit(None).cast("binary").alias("blob"), "key", now.alias("up"))
        blobs = old.filters().select("shard", "blob", F.lit(None).cast("binary").alias("key"), F.lit(True).alias("up"))
        order = ["shard", F.col("blob").isNull(), "up", "key"]
        changed = (blobs.union(moved).repartition("shard").sortWithinPartitions(*order)
                   .mapInPandas(_update, "shard int, blob binary, full boolean"))
        changed = materialize(changed, "lines-filters")
        full = changed.filter("full").select("shard")
        again = new._fresh(common.join(full, shard_of("key", shards) == F.col("shard"), "left_semi"))
        new._write_filters(changed.filter("not full").select("shard", "blob").union(again))
        return new

    def _fresh(self, keys: DataFrame) -> DataFrame:
        """Filters of the given keys, sized for them."""
        shards = self.shards

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, held = None, []
            for batch in batches:
                for s, key in zip(batch["shard"], batch["key"]):
                    if s != shard and held:
                        yield _sized_row(shard, held)
                        held = []
                    shard = s
                    held.append(key)
            if held:
                yield _sized_row(shard, held)

        return (keys.select(shard_of("key", shards).alias("shard"), "key").repartition("shard")
                .sortWithinPartitions("shard", "key").mapInPandas(build, "shard int, blob binary"))

    def _write_filters(self, filters: DataFrame) -> None:
        filters.write.mode("overwrite").parquet(self._at("filters"))

    def dropped_keys(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct ``keys`` (column ``key``) that at least ``threshold`` documents hold."""
        none = F.lit(None).cast("binary")
        asked = keys.select(shard_of("key", self.shards).alias("shard"), none.alias("blob"), "key")
        held = self.filters().select("shard", "blob", none.alias("key"))
        hits = (held.union(asked).repartition("shard").sortWithinPartitions("shard", F.col("blob").isNull())
                .mapInPandas(_probe, "key binary"))
        exact = self.counts().filter(F.col("docs") >= self.threshold).select("key")
        return hits.join(exact, "key", "left_semi")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: DataFrame | None = None) -> DataFrame:
        """(``id_col``, n_lines, n_dropped, kept) for every row: its text without the lines of common keys.

        NULL and empty texts are one empty line and stay so. Repeated rows each give a
        row; other columns are not read. Equal texts are decided once. ``places``: the documents' written ``lines``, if at hand.
        """
        require(docs, id_col, text_col)
        places = materialize(self.lines(docs, id_col, text_col), "lines-places") if places is None else places
        common = materialize(self.dropped_keys(places.select("key").distinct()), "lines-common")
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")
        gone = (places.withColumn("salt", salt).join(salted, ["key", "salt"], "left_semi")
                .select("text_key", "pos").distinct()
                .groupBy("text_key").agg(F.collect_set("pos").alias("gone")))
        spread = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        rows = rows.select("id", "text", F.unhex(F.md5("text")).alias("text_key"),
                           F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
        joined = rows.join(spread, ["text_key", "salt"], "left")
        # Only texts that lose a line travel to Python.
        shorter = _without(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone"))
        return joined.select(
            F.col("id").alias(id_col), F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce(shorter, F.col("text")).alias("kept"))


def _sized_row(shard: int, keys: list[bytes]) -> pd.DataFrame:
    room = len(keys)
    while True:
        held = CuckooFilter.sized(room)
        if all(held.add(k) for k in keys):
            return pd.DataFrame({"shard": [shard], "blob": [held.to_bytes()]})
        room = 2 * held.table.size


def dedup_lines(docs: DataFrame, threshold: int = 10, least: int = 1) -> DataFrame:
    """Insert all documents into an empty store and clean them: (doc_id, n_lines, n_dropped, kept)."""
    store = LineStore.create(docs.sparkSession, threshold=threshold, least=least)
    places = materialize(store.lines(docs), "lines-places")
    return store.insert_lines(places).clean(docs, places=places)


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (
  select doc_id, translate(trim(unnest(lines), {_WHITE}), '{UPPER}', '{LOWER}') as key from split),
common as (
  select coalesce(list(key), []) as gone
  from (select key from line where length(key) >= 1 group by key having count(distinct doc_id) >= 10)),
kept as (
  select doc_id, lines,
         list_filter(lines, lambda l: not list_contains(gone, translate(trim(l, {_WHITE}), '{UPPER}', '{LOWER}'))) as stay
  from split cross join common)
select doc_id, len(lines) as n_lines, len(lines) - len(stay) as n_dropped,
       sha256(array_to_string(stay, chr(10))) as kept_sha256
from kept
"""
