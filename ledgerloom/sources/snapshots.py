"""Versions of tables in the shared folder: immutable directories, and a pointer that moves last."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has one; a local default only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/ledgerloom-checkpoints"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark reads, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _fewer(df: DataFrame) -> DataFrame:
    """An eighth as many partitions as a shuffle has, though no fewer than keep all cores busy."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 8))


def checkpointed(df: DataFrame, *, small: bool = False) -> DataFrame:
    """df stored by a reliable checkpoint, which outlives the executors that wrote it.

    A ``small`` table, of numbers and keys beside the texts that it was made from, goes to fewer files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (_fewer(df) if small else df).checkpoint(eager=True)


class Steps:
    """Tables of a loop, in a folder of their own.

    A checkpoint keeps the size that its plan was estimated at, and a join multiplies estimates: in a loop of joins they
    grow to numbers of millions of digits.  What is read from files is as large as its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex[:10]}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        _fewer(df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df, stored by a checkpoint; the loop's tables go."""
        out = checkpointed(df, small=True)
        remove_folder(self.spark, self.folder)
        return out


class RevisionUnavailable(LookupError):
    """The revision was never published, or is gone."""


@dataclass
class SnapshotStore:
    """Published revisions of named tables under one folder.

    A revision is written whole, read back and counted, and only then named by a pointer row, itself a small
    Parquet directory that is never changed: readers take the newest pointer they can see.  Old revisions stay while they
    are leased; at most ``max_leases`` captured reads exist at once.
    """

    spark: SparkSession
    folder: str = ""
    max_leases: int = 16
    leases: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.folder = self.folder or f"{shared_folder(self.spark)}/snapshots-{uuid.uuid4().hex[:10]}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _path(self, revision: int, name: str) -> str:
        return f"{self.folder}/r{revision:012d}/{name}"

    def publish(self, revision: int, tables: dict[str, DataFrame]) -> None:
        """Writes all tables of a revision, verifies them, then moves the pointer; an existing revision is an error."""
        if revision in self.revisions():
            raise ValueError(f"revision {revision} exists")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(revision, name))
        rows = [(revision, name, self.spark.read.parquet(self._path(revision, name)).count()) for name in tables]
        self.spark.createDataFrame(rows, "revision long, name string, n long").coalesce(1).write.parquet(f"{self.folder}/pointers/p{revision:012d}")

    def revisions(self) -> list[int]:
        """Published revisions in order; the pointer folder holds one entry for each."""
        fs, path = self._fs()
        at = path(f"{self.folder}/pointers")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("p") and fs.exists(path(f"{s.getPath()}/_SUCCESS")))

    def read(self, name: str, revision: int | None = None) -> DataFrame:
        """A table at a revision, the newest if none is given."""
        there = self.revisions()
        at = (there[-1] if there else None) if revision is None else revision
        if at not in there:
            raise RevisionUnavailable(f"revision {at} isn't available")
        return self.spark.read.parquet(self._path(at, name))

    def capture(self, revision: int | None = None) -> str:
        """A lease on a revision; release it with ``release``."""
        if len(self.leases) >= self.max_leases:
            raise RuntimeError("too_large: too many captured reads")
        there = self.revisions()
        at = (there[-1] if there else None) if revision is None else revision
        if at not in there:
            raise RevisionUnavailable(f"revision {at} isn't available")
        lease = uuid.uuid4().hex
        self.leases[lease] = at
        return lease

    def leased(self, lease: str, name: str) -> DataFrame:
        return self.read(name, self.leases[lease])

    def release(self, lease: str) -> None:
        self.leases.pop(lease, None)

    def retain(self, keep: int, *, always: tuple[int, ...] = ()) -> list[int]:
        """Drops all but the newest ``keep`` revisions, those in ``always`` and leased ones; returns what went."""
        there = self.revisions()
        stay = set(there[-keep:]) | set(always) | set(self.leases.values())
        gone = [r for r in there if r not in stay]
        fs, path = self._fs()
        for r in gone:
            fs.delete(path(f"{self.folder}/pointers/p{r:012d}"), True)
            fs.delete(path(f"{self.folder}/r{r:012d}"), True)
        return gone
