"""Counters of a running stream, observed on its way and stored trigger by trigger."""

from __future__ import annotations

import io
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from fairground.sources import versions


def item_counts() -> list[Column]:
    """Of validated items: all, those dropped, and those kept without a price."""
    kept = F.col("reject_reason").isNull()
    return [F.count(F.lit(1)).alias("seen"), F.count_if(~kept).alias("dropped"), F.count_if(kept & F.col("price").isNull()).alias("unpriced")]


class TriggerCounters(StreamingQueryListener):
    """Stores what ``df.observe(name, ...)`` saw in each trigger as one batch of a log, so a replayed trigger replaces
    its own row. Observing costs no pass of its own. Counts are exact for streams that go straight to a sink; a stage
    before a shuffle that is computed again after a lost executor, or a ``foreachBatch`` that evaluates its rows
    twice, is counted twice. Triggers without rows leave no row."""

    def __init__(self, spark: SparkSession, out: str, name: str):
        self.spark, self.out, self.name, self.stored, self.failure = spark, out, name, {}, None
        self.kinds: dict[str, pa.DataType] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is not None and progress.numInputRows:
            try:
                self._store(seen.asDict(), progress.batchId)
            except Exception as e:  # an error here would be logged by the bus and lost
                self.failure = e
        self.stored[str(progress.runId)] = progress.batchId

    def _store(self, values: dict, batch_id: int) -> None:
        if all(v is None or type(v) in (int, float, bool, str) for v in values.values()):
            # a file without a Spark job: what a trigger leaves must not take longer than the trigger
            self.kinds.update({c: pa.scalar(v).type for c, v in values.items() if v is not None})
            row = pa.table({c: pa.array([v], self.kinds.get(c, pa.null())) for c, v in values.items()})
            _put(self.spark, row, f"{self.out}/batch={batch_id}")
        else:
            row = self.spark.range(0, 1, 1, 1).select(*[
                (F.lit(v).cast("long") if type(v) is int else F.lit(v)).alias(c) for c, v in values.items()
            ])
            versions.write_batch(row, self.out, batch_id)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last trigger of a run is stored; listeners hear of triggers later, of many of them the later the more.
        ``seconds`` may pass without any."""
        last, seen = query.lastProgress, -1
        until = time.monotonic() + seconds
        while last and (now := self.stored.get(str(query.runId), -1)) < last.batchId:
            if now > seen:
                seen, until = now, time.monotonic() + seconds
            if time.monotonic() > until:
                raise TimeoutError(f"trigger {last.batchId} was not reported, and none before it for {seconds} s")
            time.sleep(0.05)
        if self.failure:
            raise self.failure


def _put(spark: SparkSession, rows: pa.Table, folder: str) -> None:
    """A few rows as the only file of a folder, by whichever file system Spark has for it."""
    data = io.BytesIO()
    pq.write_table(rows, data)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to_path(folder), True)
    out = fs.create(to_path(f"{folder}/.part"))
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    if not fs.rename(to_path(f"{folder}/.part"), to_path(f"{folder}/part-{uuid.uuid4().hex}.parquet")):
        raise OSError(f"{folder} could not be written")


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    """One row per trigger: its ``batch`` and what was observed."""
    return spark.read.parquet(out)


_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
_PLAIN = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def start_steps(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start a stream of many small triggers. Hadoop's ``FileContext``, by which Spark writes what a trigger plans and
    commits, runs a shell command or two a file on a local disk, which takes a third of a small trigger; a local rename is
    atomic without it. A session that names a manager, and any other file system, keeps its own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    if not local or spark.conf.get(_MANAGER, None):
        return writer.option("checkpointLocation", checkpoint).start()
    spark.conf.set(_MANAGER, _PLAIN)
    try:
        return writer.option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.unset(_MANAGER)


def run_steps(query: StreamingQuery) -> None:
    """Let a stream with a processing-time trigger take all that has landed, step by step, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
