"""Streams as tables, joins of streams, and queries that answer again when their input has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import SnapshotStore, checkpointed, remove_folder, shared_folder


def file_stream(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a Parquet table: a folder of files, or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))


def stored(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """All that a stream has to say now, as a table: each batch is written under its number, so a repeated batch replaces its own files."""
    spark, name = stream.sparkSession, f"stream-{uuid.uuid4().hex[:10]}"
    folder = f"{shared_folder(spark)}/{name}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = checkpointed(spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns))
    remove_folder(spark, folder)
    return out


def joined_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams with one key, the right row at most ``seconds`` after the left one; both sides' states are dropped behind the watermark."""
    a, b = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late).withColumnRenamed(key, "__key")
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col(key) == F.col("__key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + gap)).drop("__key")


@dataclass
class LiveQuery:
    """A query over a growing table: after each batch it is run again, and what it says is published if it has changed.

    ``answer`` takes the table so far.  Readers take the newest revision of ``result``; ``changes`` has the number of each batch that
    changed it, which is all that is kept on the driver.
    """

    spark: SparkSession
    answer: Callable[[DataFrame], DataFrame]
    store: SnapshotStore
    folder: str = ""
    changes: list[int] = field(default_factory=list)
    digest: str = ""

    def __post_init__(self) -> None:
        self.folder = self.folder or f"{shared_folder(self.spark)}/live-{uuid.uuid4().hex[:10]}"

    def _take(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        result = self.answer(self.spark.read.parquet(f"{self.folder}/rows").where(F.col("batch") <= number).drop("batch"))
        digest = str(result.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*result.columns).cast("decimal(38,0)")).alias("h")).head())
        if digest != self.digest:
            revision = (self.store.revisions() or [-1])[-1] + 1
            self.store.publish(revision, {"result": result})
            self.changes.append(number)
            self.digest = digest

    def follow(self, stream: DataFrame) -> DataFrame:
        """Takes all that the stream has now; returns the newest answer."""
        stream.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.store.read("result")
