"""Window features that Spark's parser lacks: GROUPS frames, EXCLUDE and FILTER, as rewrites to built-in windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerloom.operators.writes import with_row_ids

Order = Sequence[str | Column]


def spec(partition: Sequence[str], order: Order) -> WindowSpec:
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))
    return w.orderBy(*order)


def with_global_rank(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rank() OVER (ORDER BY order) over all rows: numbers from ranges, of which equal rows share the least; no task orders all rows."""
    numbered = with_row_ids(rows, order, 0, "__id")
    first = numbered.groupBy(*order).agg(F.min("__id").alias(name)).select(*(F.col(c).alias(f"__{c}") for c in order), name)
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return numbered.join(first, same).drop("__id", *(f"__{c}" for c in order))


def with_groups_frame(df: DataFrame, name: str, aggregate: Column, *, partition: Sequence[str], order: Order, before: int, after: int) -> DataFrame:
    """``aggregate`` over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peers get one dense rank, and RANGE counts ranks."""
    rank = f"__{name}_rank"
    ranked = df.withColumn(rank, F.dense_rank().over(spec(partition, order)))
    frame = spec(partition, [rank]).rangeBetween(-before, after)
    return ranked.withColumn(name, aggregate.over(frame)).drop(rank)


def sum_excluding(value: Column, what: str, *, partition: Sequence[str], order: Order, first: int, last: int) -> Column:
    """sum(value) over ROWS BETWEEN first AND last EXCLUDE what ('current row', 'group', 'ties'); null over no rows.

    The excluded part is taken off, so it must lie within the frame: rows of the current peer group that the frame leaves
    out can't be told apart here, so 'group' and 'ties' need a frame that holds whole peer groups.
    """
    w = spec(partition, order)
    frame = w.rowsBetween(first, last)
    total, count = F.coalesce(F.sum(value).over(frame), F.lit(0)), F.count(value).over(frame)
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    own, one = F.coalesce(value, F.lit(0)), F.when(value.isNotNull(), 1).otherwise(0)
    if what == "current row":
        gone, n = own, one
    elif what == "group":
        gone, n = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    elif what == "ties":
        gone, n = F.coalesce(F.sum(value).over(peers), F.lit(0)) - own, F.count(value).over(peers) - one
    else:
        raise ValueError(what)
    return F.when(count > n, total - gone)


def sum_where(value: Column, condition: Column, window: WindowSpec) -> Column:
    """sum(value) FILTER (WHERE condition) OVER window."""
    return F.sum(F.when(condition, value)).over(window)


def count_where(condition: Column, window: WindowSpec) -> Column:
    """count(*) FILTER (WHERE condition) OVER window."""
    return F.count(F.when(condition, 1)).over(window)
