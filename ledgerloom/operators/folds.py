"""Folds in order: rows of each group, one after the other, in memory that doesn't grow with the group.

Rows are dealt by group and sorted within their partitions by Spark, which spills; a Python worker then reads Arrow batches and
carries one group's state from batch to batch.  No group is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch of results.
OUT_ROWS = 8_192


class Fold(Protocol):
    """What is known of a group so far."""

    def step(self, row: dict) -> Iterable[dict]:
        """Takes the next row; returns result rows."""

    def finish(self) -> Iterable[dict]:
        """Result rows after the group's last row."""


def fold_sorted(rows: DataFrame, group: str, order: Sequence[str], begin: Callable[[object], Fold], schema: str) -> DataFrame:
    """The result rows of a ``begin(key)`` for each value of ``group``, fed with the group's rows in order of ``order``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if fold is None or row[group] != key:
                    if fold is not None:
                        out.extend(fold.finish())
                    key = row[group]
                    fold = begin(key)
                out.extend(fold.step(row))
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if fold is not None:
            out.extend(fold.finish())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


class _Digest:
    def __init__(self, key: object):
        self.key, self.state, self.first = key, hashlib.sha256(), True

    def step(self, row: dict) -> Iterable[dict]:
        if row["line"] is not None:
            self.state.update(row["line"].encode() if self.first else b"\n" + row["line"].encode())
            self.first = False
        return ()

    def finish(self) -> Iterable[dict]:
        return ({"key": self.key, "digest": self.state.hexdigest()},)


def line_digests(rows: DataFrame, group: str, order: Sequence[Column], line: Column) -> DataFrame:
    """(group, digest): SHA-256 of each group's lines in order, joined by newlines; null lines don't count."""
    names = [f"o{i}" for i in range(len(order))]
    kind = rows.schema[group].dataType.simpleString()
    given = rows.select(F.col(group).alias("key"), line.alias("line"), *(c.alias(n) for c, n in zip(order, names, strict=True)))
    return fold_sorted(given, "key", names, _Digest, f"key {kind}, digest string").withColumnRenamed("key", group)
