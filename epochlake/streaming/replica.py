"""A replica kept up by Structured Streaming: changes are applied in micro-batches and seen once their epoch is committed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import WAL_PREFIX, base_name
from ..functions.versions import version
from ..operators import changelog
from ..schema import CHANGE_LOG, CLEARS, POINTS
from ..sources.wal import decode


def stream_log(spark: SparkSession, path: str, durable: int) -> DataFrame:
    """change_log of the log files of a directory as a stream: files that appear are read once, whole; rotate, then let them
    appear. Nondurable entries come with that state."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"{WAL_PREFIX}*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from decode(b.column("name")[i].as_py(), b.column("content")[i].as_buffer(), durable)

    return files.select(base_name("path").alias("name"), "content").mapInArrow(run, CHANGE_LOG)


def stream_latest(changes: DataFrame) -> DataFrame:
    """The newest entry of each key as a streaming aggregation; write it in update mode. Entries that come late are compared by
    version, so order doesn't matter."""
    return changelog.latest(changes)


def visible(changes: DataFrame, committed: int) -> DataFrame:
    """What readers of a replica may see: entries of epochs that have been committed as a group."""
    return changelog.as_of(changes, committed)


class Replica:
    """A replica in a folder of any store.

    Every micro-batch is written as a delta of its own, by its number, so that a batch which is run again replaces itself; only
    the newest entry of each key and all range deletes of a batch are kept. A commit is a row in a table of epochs. Reading
    merges the deltas; compact() folds those that are committed into a base, and writes no delta anew.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _there(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch of change_log rows. Of a key, the newest entry of each epoch stays, as a later commit may
        stop between two epochs."""
        points = batch.filter(F.col("entry_type").isin(*POINTS))
        rest = [c for c in points.columns if c not in ("storage_id", "key", "snippet_epoch")]
        ties = [c for c in ("file", "offset", "seq") if c in points.columns]
        newest = points.groupBy("storage_id", "key", "snippet_epoch").agg(F.max_by(F.struct(*rest), F.struct(version(), *ties)).alias("_best"))
        kept = newest.select("storage_id", "key", "snippet_epoch", "_best.*").select(*points.columns)
        clears = batch.filter(F.col("entry_type").isin(*CLEARS))
        kept.unionByName(clears).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")

    def commit(self, epoch: int) -> None:
        """Makes everything up to an epoch visible. Epochs may only rise; a smaller one changes nothing."""
        if epoch > self.committed():
            self.spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).write.mode("append").parquet(f"{self.path}/commits")

    def committed(self) -> int:
        if not self._there("commits"):
            return 0
        return self.spark.read.parquet(f"{self.path}/commits").agg(F.max("epoch")).first()[0] or 0

    def _base(self) -> tuple[DataFrame | None, int]:
        """The newest base with the epoch up to which it holds all."""
        if not self._there("bases"):
            return None, 0
        bases = self.spark.read.parquet(f"{self.path}/bases")
        at = bases.agg(F.max("up_to")).first()[0]
        return (None, 0) if at is None else (bases.filter(F.col("up_to") == at).drop("up_to"), at)

    def read(self, epoch: int | None = None) -> DataFrame | None:
        """The live rows at the committed epoch, or at an earlier one not below the base's; None before the first batch."""
        epoch = self.committed() if epoch is None else min(epoch, self.committed())
        base, at = self._base()
        if not self._there("deltas"):
            return base
        if epoch < at:
            raise ValueError(f"the base holds epoch {at} already")
        log = self.spark.read.parquet(f"{self.path}/deltas").drop("batch")
        if base is None:
            return changelog.snapshot(log, epoch)
        return changelog.merge_base(base, log.filter(F.col("snippet_epoch") > at), epoch)

    def compact(self) -> int:
        """Folds what is committed into a new base; the epoch that it holds. Deltas that it covers may then be deleted."""
        epoch = self.committed()
        rows = self.read(epoch)
        if rows is not None and epoch > self._base()[1]:
            rows.withColumn("up_to", F.lit(epoch).cast("long")).write.mode("append").partitionBy("up_to").parquet(f"{self.path}/bases")
        return epoch

    def start(self, changes: DataFrame, checkpoint: str, **trigger):
        """The streaming query that applies a stream of change_log rows; without a trigger, what there is now."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
