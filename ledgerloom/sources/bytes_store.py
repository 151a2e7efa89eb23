"""Keys and byte values in a folder of any file system that Spark reads: every put is a new version, and the newest one is what a get sees."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import shared_folder

MOST_KEY_BYTES = 1024


@dataclass
class BytesStore:
    """Values (key string, value binary).  A null value deletes its key.  Puts are whole: one that fails half-way is never seen."""

    spark: SparkSession
    folder: str = ""

    def __post_init__(self) -> None:
        self.folder = self.folder or f"{shared_folder(self.spark)}/bytes-{uuid.uuid4().hex[:10]}"

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.folder)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path(self.folder)))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def put(self, values: DataFrame) -> int:
        """Stores (key, value); of several values of one key in a put the greatest stays.  Returns the version."""
        if values.where(F.col("key").isNull() | (F.octet_length("key") > MOST_KEY_BYTES)).limit(1).count():
            raise ValueError("too_large: a key is null or too long")
        version = (self._versions() or [0])[-1] + 1
        once = values.groupBy("key").agg(F.max("value").alias("value"))
        once.write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        return version

    def all(self, version: int | None = None) -> DataFrame:
        """(key, value) as of a version, the newest if none is given."""
        there = [v for v in self._versions() if version is None or v <= version]
        if not there:
            return self.spark.createDataFrame([], "key string, value binary")
        rows = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/version={v}" for v in there))
        newest = rows.groupBy("key").agg(F.max_by(F.struct("value"), "version").alias("v"))
        return newest.select("key", "v.value").where("value IS NOT NULL")

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the asked keys that are there."""
        return self.all().join(keys.select("key").distinct(), "key", "left_semi")

    def keys(self, prefix: str = "") -> DataFrame:
        return self.all().where(F.col("key").startswith(prefix)).select("key")
