"""Base tables, their metadata, and values as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Primary keys and foreign keys (column, parent, parent column) of the star schema.
KEYS: dict[str, tuple[str, ...]] = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",)}
FOREIGN_KEYS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "nation": (("n_regionkey", "region", "r_regionkey"),),
    "customer": (("c_nationkey", "nation", "n_nationkey"),),
    "supplier": (("s_nationkey", "nation", "n_nationkey"),),
    "orders": (("o_custkey", "customer", "c_custkey"),),
    "lineitem": (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
}

#: Rows that one bulk seed may have.
MAX_SEED_ROWS = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: Sequence[Sequence[object]], types: Sequence[str]) -> DataFrame:
    """Rows as a table with columns column1, column2, ..."""
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"column{i + 1} {t}" for i, t in enumerate(types)))


def table_info(df: DataFrame, name: str, key: Sequence[str] = ()) -> DataFrame:
    """One row for each column of a table: table_name, cid, name, type, not_null and its place in the primary key (0: none)."""
    place = {c: i + 1 for i, c in enumerate(key)}
    rows = [(name, i, f.name, f.dataType.simpleString(), int(not f.nullable), place.get(f.name, 0)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, cid int, name string, type string, not_null int, pk int")


def table_list(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> DataFrame:
    """One row for each table: its name and number of columns."""
    rows = [(n, len(read_table(spark, sf_dir, n).columns)) for n in names]
    return spark.createDataFrame(rows, "name string, ncol int")


def foreign_key_list(spark: SparkSession, names: Sequence[str] = TABLES) -> DataFrame:
    """One row for each foreign key: the child's table and column, the parent's table and column."""
    rows = [(t, i, p, c, pc) for t in names for i, (c, p, pc) in enumerate(FOREIGN_KEYS.get(t, ()))]
    return spark.createDataFrame(rows, "child string, id int, parent string, child_column string, parent_column string")


def index_list(spark: SparkSession, names: Sequence[str] = TABLES) -> DataFrame:
    """One row for each column of each primary key, which stands for the unique index behind it."""
    rows = [(t, f"pk_{t}", i, c) for t in names for i, c in enumerate(KEYS.get(t, ()))]
    return spark.createDataFrame(rows, "table_name string, index_name string, seqno int, column_name string")


def quick_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Problems of a table's key as rows (problem, n): null parts and repeated keys; no rows if it is sound."""
    nulls = df.where(" OR ".join(f"{c} IS NULL" for c in key)).agg(F.count("*").alias("n")).select(F.lit("null key").alias("problem"), "n")
    again = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated key").alias("problem"), "n")
    return nulls.unionByName(again).where("n > 0")


def seed_rows(df: DataFrame, owners: DataFrame, *, owner_key: str, seed: str | None = None, most: int = MAX_SEED_ROWS) -> DataFrame:
    """Rows for a bulk seed, each with its owner's principal id; refused if they are more than ``most`` or an owner is unknown.

    ``owners``: (key, id).  The column ``seed`` tells several seeds apart, and the bound is on each of them; without it all rows are one seed,
    whose count is taken on one more row than allowed.
    """
    if (df.limit(most + 1).count() > most) if seed is None else df.groupBy(seed).count().where(F.col("count") > most).limit(1).count():
        raise ValueError("too_large: a seed has more rows than allowed")
    out = df.join(owners.select(F.col("key").alias(owner_key), F.col("id").alias("owner")), owner_key, "left")
    if out.where(F.col("owner").isNull()).limit(1).count():
        raise ValueError("constraint: a seed names an owner that is no principal")
    return out
