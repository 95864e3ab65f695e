"""Incremental loading with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pactloom.operators.versions import Versions


def stream_files(spark: SparkSession, path: str, late: str | None = None) -> DataFrame:
    """New files of a landing folder, each content once (by hash, in the stream's state).

    With `late`, a hash is kept until the newest file is so much younger, so that the state is bounded; a copy that comes after that passes here and
    is refused by the upsert of its batch (E1).
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    rows = files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("size_bytes"), "modificationTime")
    return rows.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]) if late else rows.dropDuplicates(["sha256"])


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands all that is new to `apply` in batches and ends; an upsert there makes a repeated batch harmless."""
    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(stream: DataFrame, table: Versions, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch becomes one version of the table, numbered by the batch: merge(present table or None, batch).

    A batch that is committed already is skipped whole; one that was lost before its commit is made anew from the last committed version. So a stream that is
    killed at any time and started again gives the same rows.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number in table.committed() or any(n > number for n in table.committed()):
            return
        table.write(merge(table.read(), batch), number)
        table.commit(number)

    return ingest(stream, apply, checkpoint, mode)


def run_counts(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs by window, extractor and status; rows later than `late` are left out."""
    return runs.withWatermark("started_at", late).groupBy(F.window("started_at", window), "extractor_name", "run_status").agg(F.count("*").alias("runs"))


class LatestRun(StatefulProcessor):
    """Keeps a key's latest run by (started_at, run_id) and gives it again when a later one comes.

    A timer drops the state once the watermark has passed the run: what comes then is younger in any case.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "started_at timestamp, run_id string, run_status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = self.latest.get() if self.latest.exists() else None
        best = old
        for frame in rows:
            for run in frame[["started_at", "run_id", "run_status"]].itertuples(index=False, name=None):
                if best is None or (pd.Timestamp(run[0]), run[1]) > (pd.Timestamp(best[0]), best[1]):
                    best = run
        if best is not None and best is not old:
            if old is not None:
                self.handle.deleteTimer(millis(old[0]))
            self.latest.update(best)
            self.handle.registerTimer(millis(best[0]))
            yield pd.DataFrame({"file_id": [key[0]], "extractor_name": [key[1]], "started_at": [pd.Timestamp(best[0])], "run_id": [best[1]], "run_status": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def millis(at) -> int:  # noqa: ANN001
    """A time's milliseconds, rounded up."""
    return -(-int(pd.Timestamp(at).value) // 1_000_000) + 1


def latest_runs(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """The latest run of each (file_id, extractor_name), given anew when it changes; rows later than `late` are left out.

    Needs the RocksDB state store (`state_store`). Rows without a time or an id are left out; repeated rows change nothing.
    """
    rows = runs.where("started_at IS NOT NULL AND run_id IS NOT NULL").select("file_id", "extractor_name", "started_at", F.col("run_id").cast("string").alias("run_id"), "run_status").withWatermark("started_at", late)
    schema = "file_id string, extractor_name string, started_at timestamp, run_id string, run_status string"
    return rows.groupBy("file_id", "extractor_name").transformWithStateInPandas(LatestRun(), schema, "Update", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Use the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
