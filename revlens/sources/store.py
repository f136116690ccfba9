"""Table of record for predictions (S7, S9): rows, rollups and id bitmaps under one commit list.

``append`` stores a micro-batch: its rows by ingest day, its partial counts, the ids it
brings and its id bitmap are written into new folders, and one commit makes them all part of the
table. A batch that the list holds already is not stored again, so that neither rows
nor counts see a replay twice; a writer that dies before its commit leaves
only folders that nobody reads. Readers take the folders of one version and are not disturbed by
later commits.

``compact`` works on closed batches only: the folders of days before a given one that hold loose
batches become range-clustered files of a target size, and small parts of rollups, ids and bitmaps
are merged in tiers (``fan`` parts of a tier become one of the next), so that files and folders stay few and no
pass reads again what is already compact.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.operators import bitmaps, rollup
from revlens.schemas import PREDICTION
from revlens.sources.commits import CommitList, Conflict, State

ROWS, ROLLUP, IDS, BITMAPS = "rows", "rollup", "ids", "bitmaps"
FAN = 8
TARGET_BYTES = 256 * 1024 * 1024
#: Unpacked rows that one task of a compaction sorts: stored bytes say little about them, as like rows are packed well.
SORT_BYTES = 256 * 1024 * 1024
ROW_BYTES = 200   # a row without its texts
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class PredictionStore:
    """``lanes`` (numbering of product ids) is fixed for a table's life; ``fan`` parts of a tier are merged at a time."""

    def __init__(self, spark: SparkSession, path: str, lanes: int = bitmaps.LANES, fan: int = FAN):
        self.spark, self.path, self.lanes, self.fan = spark, path, lanes, fan
        self.log = CommitList(spark, path)

    # -------------------------------------------------------------- writing
    def append(self, batch: DataFrame, run: str, batch_id: int) -> int:
        """Store one micro-batch of a writer; returns the rows stored (0 if empty or already stored).

        Rows without ``inserted_at`` get one time stamp for the batch (P22). Batches of a run come in order of their ids.
        """
        state = self.log.state()
        if state.runs.get(run, -1) >= batch_id:
            return 0
        if "inserted_at" not in batch.columns:
            batch = batch.withColumn("inserted_at", F.current_timestamp())
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION.fields]).persist()
        try:
            if batch.isEmpty():
                return 0
            added, rows = self._write_rows(batch)
            entry = {"run": run, "batch": batch_id, "add": added + [self._write(rollup.partial_counts(batch), ROLLUP)]}
            ids = batch.select(F.col("ProductId").alias("id")).filter("id is not null").distinct().persist()
            try:
                self.log.commit(self._with_ids(entry, state, ids), state, lambda e, s: self._with_ids(e, s, ids))
            finally:
                ids.unpersist()
            return rows
        except Conflict:
            return 0
        finally:
            batch.unpersist()

    def _write_rows(self, batch: DataFrame) -> tuple[list[dict], int]:
        """Rows by ingest day into a new folder: an entry per day, and the number of rows."""
        name, seen = f"{ROWS}/{uuid.uuid4().hex}", Observation(f"stored_{uuid.uuid4().hex}")
        (batch.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("ingest_date", F.to_date("inserted_at"))
         .write.partitionBy("ingest_date").parquet(os.path.join(self.path, name)))
        return self._days_of(name, tier=0), int(seen.get["rows"])

    def _days_of(self, name: str, tier: int) -> list[dict]:
        days = [n for n, _, _ in self.log.files.list(os.path.join(self.path, name)) if n.startswith("ingest_date=")]
        return [self._facts(f"{name}/{day}", ROWS, tier) | {"day": day.split("=", 1)[1]} for day in days]

    def _facts(self, path: str, kind: str, tier: int) -> dict:
        files, size = self.log.files.size(os.path.join(self.path, path))
        return {"path": path, "kind": kind, "tier": tier, "files": files, "bytes": size}

    def _write(self, df: DataFrame, kind: str, tier: int = 0) -> dict:
        path = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(self.path, path))
        return self._facts(path, kind, tier)

    def _with_ids(self, entry: dict, state: State, ids: DataFrame) -> dict:
        """The entry with new id numbers and the batch's bitmap, by the ids of ``state``.

        If another writer has numbered ids meanwhile, they are made again: no number is given twice.
        """
        basis = sorted(f["path"] for f in state.of(IDS))
        if entry.get("ids_on") == basis:
            return entry
        known = self._read(state, IDS, bitmaps.IDS)
        numbers = self._write(bitmaps.new_numbers(ids, known, self.lanes), IDS)
        fresh = self.spark.read.schema(bitmaps.IDS).parquet(os.path.join(self.path, numbers["path"]))
        maps = self._write(bitmaps.bitmaps(ids, known.union(fresh)), BITMAPS)
        kept = [f for f in entry["add"] if f["kind"] not in (IDS, BITMAPS)]
        return entry | {"add": [*kept, numbers, maps], "ids_on": basis}

    # -------------------------------------------------------------- reading
    def _read(self, state: State, kind: str, schema, folders: list[dict] | None = None) -> DataFrame:
        folders = state.of(kind) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.path, f["path"]) for f in folders])

    def version(self) -> int:
        return self.log.state().version

    def predictions(self, version: int | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """The rows of a version (the newest by default), of ingest days in a range: other days' folders are not opened."""
        state = self.log.state(version)
        days = [f for f in state.of(ROWS) if f["day"] == NO_DAY and not (first_day or last_day)
                or f["day"] != NO_DAY and (first_day or "") <= f["day"] <= (last_day or "9999")]
        return self._read(state, ROWS, PREDICTION, days)

    def counts(self, version: int | None = None) -> DataFrame:
        """The partial counts of a version (see ``operators.rollup``)."""
        return self._read(self.log.state(version), ROLLUP, rollup.PARTS)

    def id_bitmaps(self, version: int | None = None) -> DataFrame:
        return self._read(self.log.state(version), BITMAPS, bitmaps.MAPS)

    # ----------------------------------------------------------- compaction
    def compact(self, before: str | dt.date, target_bytes: int = TARGET_BYTES) -> dict[str, int]:
        """Compact what is closed: ingest days before ``before``, and small parts of the rollup, the ids and the bitmaps.

        Returns the folders replaced by kind. A concurrent compaction of the same folders makes this one give way.
        """
        before, done = str(before), {}
        by_day: dict[str, list[dict]] = {}
        for f in self.log.state().of(ROWS):
            if f["day"] != NO_DAY and f["day"] < before:
                by_day.setdefault(f["day"], []).append(f)
        loose = [f for fs in by_day.values() for f in fs if f["tier"] == 0]
        # A day that late batches have opened many times is written as a whole again.
        loose += [f for fs in by_day.values() for f in fs if f["tier"] > 0 and sum(g["tier"] > 0 for g in fs) >= self.fan]
        if loose:
            done[ROWS] = self._replace(loose, lambda: self._compact_rows(loose, target_bytes))
        for kind, schema, merge in ((ROLLUP, rollup.PARTS, rollup.merged), (BITMAPS, bitmaps.MAPS, bitmaps.merged), (IDS, bitmaps.IDS, None)):
            tier = 0
            while len(parts := [f for f in self.log.state().of(kind) if f["tier"] == tier]) >= self.fan:
                done[kind] = done.get(kind, 0) + self._replace(parts, lambda: [self._merge(parts, kind, schema, merge, tier + 1, target_bytes)])
                tier += 1
        return done

    def _replace(self, old: list[dict], make) -> int:
        state = self.log.state()
        try:
            self.log.commit({"remove": [f["path"] for f in old], "add": make()}, state)
        except Conflict:
            return 0
        return len(old)

    def _compact_rows(self, folders: list[dict], target_bytes: int) -> list[dict]:
        """Closed days as files clustered by (day, product, time), with a bloom filter on the product.

        A file is at most about ``target_bytes`` long, and shorter where its rows unpacked would be more than one task should sort.
        """
        rows = self._read(State(), ROWS, PREDICTION, folders).withColumn("ingest_date", F.to_date("inserted_at"))
        texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("Summary", "Text", "cleaned")), F.lit(ROW_BYTES).cast("long"))
        unpacked = rows.agg(F.sum(texts)).first()[0] or 0
        files = max(1, -(-sum(f["bytes"] for f in folders) // target_bytes), -(-unpacked // SORT_BYTES))
        name = f"{ROWS}/{uuid.uuid4().hex}"
        (rows.repartitionByRange(files, "ingest_date", "ProductId", "Time", "Id").sortWithinPartitions("ingest_date", "ProductId", "Time")
         .write.partitionBy("ingest_date").option("parquet.bloom.filter.enabled#ProductId", "true").parquet(os.path.join(self.path, name)))
        return self._days_of(name, tier=1)

    def _merge(self, parts: list[dict], kind: str, schema, merge, tier: int, target_bytes: int) -> dict:
        df = self._read(State(), kind, schema, parts)
        files = max(1, -(-sum(f["bytes"] for f in parts) // target_bytes))
        return self._write((merge(df) if merge else df).coalesce(files), kind, tier)

    def vacuum(self, older_than_s: float = 86400) -> int:
        """Delete folders that no commit names or that compaction replaced, once they are old enough."""
        return self.log.vacuum(older_than_s, [ROWS, ROLLUP, IDS, BITMAPS])


def start_store_query(scored: DataFrame, store: PredictionStore, checkpoint: str, trigger: str = "10 seconds",
                      available_now: bool = False):
    """S7 into the store: the run's name lives in the checkpoint, so that a restart goes on and a fresh one is a new writer."""
    from revlens.streaming.scoring import run_name

    run = run_name(scored.sparkSession, checkpoint)
    writer = scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: store.append(b, run, i))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
