"""User aggregates in two phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_aggregate(rows: DataFrame, key: str, value: str, partial: Callable[[np.ndarray], tuple[int, float]], final: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, value, n) of an aggregate that user code computes.

    ``partial(values)`` gives the count and one additive state of a batch's values of one key; the states are summed by Spark, and ``final(n, state)``
    makes the result.  Nulls don't count.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code, x = pc.fill_null(keys.indices, len(keys.dictionary)).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            parts = [(int(c), *partial(x[code == c])) for c in np.unique(code)]
            names = pa.array([keys.dictionary[c].as_py() if c < len(keys.dictionary) else None for c, _, _ in parts], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([names, pa.array([n for _, n, _ in parts], pa.int64()), pa.array([s for _, _, s in parts], pa.float64())], names=["key", "n", "state"])

    given = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    summed = given.mapInArrow(run, f"key {kind}, n long, state double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("state").alias("state"))
    return summed.select(F.col("key").alias(key), final(F.col("n"), F.col("state")).alias("value"), "n")
