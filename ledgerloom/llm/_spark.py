"""Spark helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import checkpointed as cut
from ledgerloom.sources.snapshots import shared_folder

__all__ = ["LAST_ID", "cut", "fresh", "held_out", "shared_folder", "shuffle_partitions", "table"]

#: Sorts after every stored id: where a null id stands in an order.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
