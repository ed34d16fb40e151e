"""A folder of notes as a stream: each trigger indexes what came since the last one; or, with a debounce, a stream of
changes of which a note's last one comes out once the note has been quiet for a while."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship_package
from ..sources import vault

QUIET_SECONDS = 2.0


def watch(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool = True):
    """handle(notes, batch id) gets each micro-batch of new notes; deletions need Indexer.sync."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.element_at(F.split("path", root.rstrip("/").split("://")[-1] + "/", 2), -1).alias("path"), "content", F.col("modificationTime").cast("double").alias("mtime"))
        handle(vault.read_notes(rows), batch_id)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


class _Quiet(StatefulProcessor):
    """Holds a note's last change and a timer that each change moves on; when it rings, the change comes out."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen timestamp, changes long, rings long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen, changes = None, 0
        for batch in rows:
            seen, changes = max([x for x in (seen, batch["seen"].max()) if x is not None]), changes + len(batch)
        if self.last.exists():
            old = self.last.get()
            self.handle.deleteTimer(old[2])
            seen, changes = max(seen, pd.Timestamp(old[0])), changes + old[1]
        rings = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(rings)
        self.last.update((seen.to_pydatetime(), int(changes), int(rings)))
        yield pd.DataFrame({"path": pd.Series(dtype="str"), "seen": pd.Series(dtype="datetime64[ns]"), "changes": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen, changes, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"path": [key[0]], "seen": [pd.Timestamp(seen)], "changes": [changes]})

    def close(self) -> None:
        pass


def quiet_changes(changes: DataFrame, quiet_seconds: float = QUIET_SECONDS) -> DataFrame:
    """changes(path, seen), a stream -> path, seen (of the last change), changes (how many there were): one row for a
    note once no change of it came for quiet_seconds. State is one row for a note that is not quiet yet."""
    ship_package(changes.sparkSession)
    return changes.select("path", "seen").groupBy("path").transformWithStateInPandas(_Quiet(int(quiet_seconds * 1000)), "path string, seen timestamp, changes long", "Append", "ProcessingTime")


def index_quiet_notes(changes: DataFrame, indexer, checkpoint: str, quiet_seconds: float = QUIET_SECONDS, every: str = "1 second"):
    """Index each note of changes(path, seen) once it is quiet; a note that is gone by then leaves the index with the
    next sync. The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # notes that became quiet since the last batch
        for path in sorted(paths):
            try:
                indexer.index_file(path, job_id=1_000_000 + batch_id)
            except FileNotFoundError:
                continue

    return quiet_changes(changes, quiet_seconds).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(each).trigger(processingTime=every).start()
