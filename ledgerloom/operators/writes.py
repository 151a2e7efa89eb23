"""Writes as rewrites of a table's rows: each returns the table's next state as a DataFrame.

Statements of several rows follow the order of ``order`` where their outcome depends on it; later rows win or lose as in a
row-by-row engine, decided by a window over the key and not by a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.snapshots import checkpointed


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT: rows by column name; a column they lack takes its default, else null."""
    defaults = defaults or {}
    full = rows.select(*(F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return table.unionByName(full)


def update(table: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... WHERE: new values are computed from the old row; a null condition leaves the row."""
    return table.select(*(F.when(where, changes[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE: a null condition keeps the row."""
    return table.where(~F.coalesce(where, F.lit(False)))


def _one_each(rows: DataFrame, key: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def replace(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """INSERT OR REPLACE: rows of an existing key go first; of several new rows of one key the last stays."""
    new = _one_each(rows, key, order, last=True).select(*table.columns)
    return table.join(new.select(*key), list(key), "left_anti").select(*table.columns).unionByName(new)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """INSERT OR IGNORE / ON CONFLICT DO NOTHING: existing keys win, of several new rows of one key the first."""
    new = _one_each(rows, key, order, last=False).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], changes: Mapping[str, str], where: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET column = expression [WHERE ...].

    Expressions name the existing row's columns as ``old.c`` and the proposed row's as ``excluded.c``; ``rows`` has one row for a key.
    """
    both = table.alias("old").join(rows.alias("excluded"), [F.col(f"old.{k}").eqNullSafe(F.col(f"excluded.{k}")) for k in key], "full_outer")
    there, proposed = F.col(f"old.{key[0]}").isNotNull(), F.col(f"excluded.{key[0]}").isNotNull()
    hit = there & proposed & (F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False)))
    out = []
    for c in table.columns:
        changed = F.expr(changes[c]) if c in changes else F.col(f"old.{c}")
        out.append(F.when(hit, changed).when(there, F.col(f"old.{c}")).otherwise(F.col(f"excluded.{c}")).cast(table.schema[c].dataType).alias(c))
    return both.select(*out)


def update_from(table: DataFrame, source: DataFrame, on: Sequence[str], changes: Mapping[str, str]) -> DataFrame:
    """UPDATE ... FROM: expressions name ``old.c`` and ``src.c``; ``source`` has one row for a key."""
    both = table.alias("old").join(source.withColumn("__hit", F.lit(True)).alias("src"), [F.col(f"old.{k}") == F.col(f"src.{k}") for k in on], "left")
    return both.select(*(F.when(F.col("__hit"), F.expr(changes[c])).otherwise(F.col(f"old.{c}")).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(f"old.{c}") for c in table.columns))


def delete_limited(table: DataFrame, where: Column, order: Sequence[Column], limit: int, key: Sequence[str]) -> DataFrame:
    """DELETE ... WHERE ... ORDER BY ... LIMIT n: the first rows of the order go."""
    doomed = table.where(where).orderBy(*order).limit(limit).select(*key)
    return table.join(doomed, list(key), "left_anti").select(*table.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a write returns: key, change ('insert', 'update', 'delete') of rows that differ between two states."""
    rest = [c for c in before.columns if c not in key]
    both = before.alias("b").join(after.alias("a"), [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key], "full_outer")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    kind = F.when(F.col(f"b.{key[0]}").isNull(), "insert").when(F.col(f"a.{key[0]}").isNull(), "delete").when(~same, "update")
    return both.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key), kind.alias("change")).where("change IS NOT NULL")


def with_row_ids(rows: DataFrame, order: Sequence[str], start: Column | int, name: str) -> DataFrame:
    """AUTOINCREMENT: numbers after ``start`` in the rows' order.

    The rows are sorted in ranges once, and stored with their range and their place in it; both the ranges' counts and the numbers
    come from what is stored, so they agree however Spark would deal the rows another time.  No task orders all rows.
    """
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))  # a row for each partition
    before = counts.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    first = F.lit(start) if isinstance(start, int) else start
    return placed.withColumn(name, first + F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", "__at")


def violations(table: DataFrame, *, unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None, foreign: Sequence[tuple[Sequence[str], DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """(constraint, n) of each constraint that rows break; a foreign key with a null part is no reference."""
    found = []
    for key in unique:
        found.append(table.dropna(subset=list(key)).groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique:" + ",".join(key)).alias("constraint"), "n"))
    single = {f"not_null:{c}": F.col(c).isNull() for c in not_null} | {f"check:{k}": ~F.coalesce(F.expr(e), F.lit(True)) for k, e in (checks or {}).items()}
    if single:
        counts = table.agg(*(F.count(F.when(v, 1)).alias(f"v{i}") for i, v in enumerate(single.values())))
        found.append(counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("constraint"), F.col(f"v{i}").alias("n")) for i, k in enumerate(single)))).alias("x")).select("x.*"))
    for child, parent, key in foreign:
        lost = table.dropna(subset=list(child)).join(parent.select(*(F.col(k).alias(c) for k, c in zip(key, child, strict=True))), list(child), "left_anti")
        found.append(lost.agg(F.count("*").alias("n")).select(F.lit("foreign_key:" + ",".join(child)).alias("constraint"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")
