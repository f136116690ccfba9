"""Latest-version table of a stateful aggregate (T4s): a batch writes the rows that changed, a read gives each key's newest.

For a query in update mode: of many keys only those with new events are written, and no
batch rewrites the whole result as complete mode does. Batches are commits of a list
(``sources.commits``), so that a replay counts once; when ``fan`` parts have come together they become one with
each key's newest row, and ``vacuum`` removes the old folders. One query writes a table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revlens.sources.commits import CommitList, Conflict

KIND, AT = "changes", "_at"


class LatestTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, fan: int = 8):
        self.spark, self.path, self.keys, self.fan = spark, path, keys, fan
        self.schema = StructType([*schema.fields, StructField(AT, LongType(), False)])
        self.values = [f.name for f in schema.fields if f.name not in keys]
        self.log = CommitList(spark, path)

    def put(self, changed: DataFrame, run: str, batch_id: int) -> bool:
        """Store the changed rows (one a key) of a batch; False if the batch is empty or stored already."""
        state = self.log.state()
        if state.runs.get(run, -1) >= batch_id:
            return False
        changed = changed.persist()
        try:
            if changed.isEmpty():
                return False
            part = self._write(changed.withColumn(AT, F.lit(state.version + 1).cast("long")), 0)
            self.log.commit({"run": run, "batch": batch_id, "add": [part]}, state)
        except Conflict:
            return False
        finally:
            changed.unpersist()
        self._merge()
        return True

    def _write(self, df: DataFrame, tier: int) -> dict:
        path = f"{KIND}/{uuid.uuid4().hex}"
        df.select(*[f.name for f in self.schema.fields]).write.parquet(os.path.join(self.path, path))
        return {"path": path, "kind": KIND, "tier": tier}

    def _newest(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[os.path.join(self.path, p["path"]) for p in parts])
        last = F.max_by(F.struct(*self.values, AT), AT).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*")

    def _merge(self) -> None:
        tier = 0
        while True:
            state = self.log.state()
            parts = [p for p in state.of(KIND) if p["tier"] == tier]
            if len(parts) < self.fan:
                return
            # Few rows a part: the newest of each key, written as one file.
            whole = self._write(self._newest(parts).coalesce(1), tier + 1)
            self.log.commit({"remove": [p["path"] for p in parts], "add": [whole]}, state)
            tier += 1

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of every key, as of a version."""
        return self._newest(self.log.state(version).of(KIND)).drop(AT)

    def vacuum(self, older_than_s: float = 3600) -> int:
        return self.log.vacuum(older_than_s, [KIND])


def start_latest_query(result: DataFrame, table: LatestTable, checkpoint: str, available_now: bool = False,
                       trigger: str = "1 second"):
    """Run a stateful aggregate in update mode into a latest-version table."""
    from revlens.streaming.scoring import run_name

    run = run_name(result.sparkSession, checkpoint)
    w = (result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: table.put(b, run, i)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
