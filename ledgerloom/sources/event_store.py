"""An append-only history of events: immutable segments, each linked to the one before, and heads that move last.

A segment is a Parquet directory; its digest covers the digest before it, its count, and the sum of its rows' hashes, which
include their places.  A head is a one-row directory that names a segment; an append reads the newest complete one.  Segments and heads
are partitions of two tables, so a load recomputes all digests and checks all links in one grouping and one join.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import shared_folder

MOST_RECORDS = 100_000


class BrokenHistory(ValueError):
    """A segment's digest or link doesn't fit."""


@dataclass
class EventStore:
    spark: SparkSession
    folder: str = ""

    def __post_init__(self) -> None:
        self.folder = self.folder or f"{shared_folder(self.spark)}/events-{uuid.uuid4().hex[:10]}"

    def _newest(self) -> Row | None:
        """The newest complete head."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(f"{self.folder}/heads")):
            return None
        for name in sorted((s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/heads"))), reverse=True):
            if name.startswith("segment=") and fs.exists(path(f"{self.folder}/heads/{name}/_SUCCESS")):
                return self.spark.read.option("basePath", f"{self.folder}/heads").schema(_HEAD).parquet(f"{self.folder}/heads/{name}").head()
        return None

    def append(self, events: DataFrame) -> None:
        """Adds events (idx, ...), whose places must follow the last one."""
        newest = self._newest()
        before, top, number = (newest.digest, newest.top, int(newest.segment) + 1) if newest else ("", 0, 0)
        name = f"segment={number:09d}"
        events.write.mode("overwrite").parquet(f"{self.folder}/segments/{name}")
        rows = self.spark.read.parquet(f"{self.folder}/segments/{name}")
        if rows.where(F.col("idx") <= top).limit(1).count():
            raise BrokenHistory("a place that is already taken")
        found = rows.agg(*_totals(rows), F.coalesce(F.max("idx"), F.lit(0)).alias("last")).withColumn("before", F.lit(before))
        head = found.select("before", _link(F.col("before")).alias("digest"), "n", F.greatest(F.col("last"), F.lit(top)).alias("top"))
        head.coalesce(1).write.parquet(f"{self.folder}/heads/{name}")

    def load(self, *, verify: bool = True) -> DataFrame:
        """All events; with ``verify`` every segment's digest is recomputed and every link checked first."""
        newest = self._newest()
        if newest is None:
            raise BrokenHistory("no history")
        segments = self.spark.read.parquet(f"{self.folder}/segments").withColumn("segment", F.lpad(F.col("segment").cast("string"), 9, "0")).where(F.col("segment") <= newest.segment)
        heads = self.spark.read.schema(_HEAD).parquet(f"{self.folder}/heads").where(F.col("segment") <= newest.segment)
        if verify:
            rows = segments.drop("segment")
            made = segments.groupBy("segment").agg(*_totals(rows))
            previous = heads.select(F.lpad((F.col("segment").cast("long") + 1).cast("string"), 9, "0").alias("segment"), F.col("digest").alias("linked"))
            joined = heads.drop("n").join(made, "segment", "left").join(previous, "segment", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("h", F.coalesce("h", F.lit("0")))
            wrong = joined.where((F.col("before") != F.coalesce("linked", F.lit(""))) | (F.col("digest") != _link(F.col("before")))).select(F.min("segment").alias("s")).head().s
            if wrong is not None or heads.count() != int(newest.segment) + 1:
                raise BrokenHistory(f"segment {wrong}")
        return segments.drop("segment")


_HEAD = "before string, digest string, n long, top long, segment string"


def _totals(rows: DataFrame) -> list[Column]:
    """Count and sum of hashes of rows."""
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")]


def _link(before: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, F.col("n").cast("string"), F.col("h")), 256)


def chunks(content: DataFrame, id_col: str, data_col: str, size: int = 64 << 10) -> DataFrame:
    """(id, chunk, data) of binary contents, cut into chunks of ``size`` bytes."""
    raw = F.col(data_col).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / size)).cast("int")
    return content.select(F.col(id_col).alias("id"), raw.alias("raw"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select("id", "chunk", F.substring("raw", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def read_range(chunked: DataFrame, offset: int, length: int, size: int = 64 << 10) -> DataFrame:
    """(id, data) of bytes offset to offset + length - 1: only the chunks that hold them are read, at most length / size + 2 for a content."""
    lo, hi = offset // size, (offset + length - 1) // size
    found = chunked.where(F.col("chunk").between(lo, hi)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex("data").alias("h")))).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["h"]), "")
    start = 2 * (offset - lo * size)
    return found.select("id", F.unhex(F.substring(whole, start + 1, 2 * length)).alias("data"))
