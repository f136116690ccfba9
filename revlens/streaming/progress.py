"""Progress of streams as a table (T2s, Q2, Q3): a query listener writes a snapshot for every batch and idle time.

A snapshot is a small JSON file: the topic, the messages received so far, and the rows of
this report. The total is the sum of the end offsets where the source counts messages (Kafka), else
the rows read so far; it goes on from the newest snapshot of the topic after a
restart. ``operators.quality.traffic`` reads the table: a total that did not grow fails.
(A sink that runs several jobs over a batch makes Spark report its rows several times;
for such a query give the listener a source that counts messages.)
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from revlens.schemas import OFFSET_SNAPSHOT
from revlens.sources.commits import Files
from revlens.streaming.monitors import offsets_total


class ProgressLog(StreamingQueryListener):
    """Writes the snapshots of the queries in ``topics`` (query name -> topic) to ``path``."""

    def __init__(self, spark: SparkSession, path: str, topics: dict[str, str]):
        self.files, self.path, self.topics = Files(spark), path, topics
        self.names: dict[str, str] = {}     # query id -> query name
        self.reports: dict[str, int] = {}   # topic -> reports in this session
        self.totals = {t: self._last_total(t) for t in topics.values()}

    def _folder(self, topic: str) -> str:
        return os.path.join(self.path, f"of={topic}")

    def _last_total(self, topic: str) -> int:
        names = sorted(n for n, _, _ in self.files.list(self._folder(topic)) if n.endswith(".json"))
        return json.loads(self.files.read(os.path.join(self._folder(topic), names[-1])))["total"] if names else 0

    def _write(self, topic: str, rows: int) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        snapshot = {"run_time": now.strftime("%Y-%m-%dT%H:%M:%S.%f"), "topic": topic, "total": self.totals[topic], "rows": rows}
        # Names in time order; a report of another session at the same time has a name of its own.
        name = f"{time.time_ns():020d}-{os.getpid()}.json"
        self.files.write(os.path.join(self._folder(topic), name), json.dumps(snapshot))
        self.reports[topic] = self.reports.get(topic, 0) + 1

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        topic = self.topics.get(p.name)
        if topic is None:
            return
        counted = offsets_total(json.loads(p.json))
        self.totals[topic] = sum(counted.values()) if counted else self.totals[topic] + p.numInputRows
        self._write(topic, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        topic = self.topics.get(self.names.get(str(event.id)))
        if topic is not None:
            self._write(topic, 0)

    def onQueryTerminated(self, event) -> None:
        self.names.pop(str(event.id), None)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The written snapshots (run_time, topic, total), for ``quality.traffic``."""
    return spark.read.schema(OFFSET_SNAPSHOT).json(path).select(*[f.name for f in OFFSET_SNAPSHOT.fields])


def wait_for(condition, seconds: float = 60) -> bool:
    """Wait until reports that come behind a query have been written."""
    end = time.time() + seconds
    while not condition():
        if time.time() > end:
            return False
        time.sleep(0.1)
    return True
