"""Event stores, content ranges, budgets, and extensions beyond the reference."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import ledgers
from ledgerloom.catalog._registry import Registry
from ledgerloom.ledger import replay
from ledgerloom.operators import aggregates, recursion
from ledgerloom.plans.budget import within
from ledgerloom.plans.policy import Rejected
from ledgerloom.sources.bytes_store import BytesStore
from ledgerloom.sources.event_store import EventStore, chunks, read_range
from ledgerloom.sources.snapshots import checkpointed, remove_folder, shared_folder
from ledgerloom.sources.tables import read_table

REGISTRY = Registry()
sql, query = REGISTRY.sql, REGISTRY.query


@query("event_store", "SRC-16 SRC-17", "SELECT event_id + 1 AS idx, event_type AS topic, props AS payload FROM events")
def event_store(spark: SparkSession, d: str) -> DataFrame:
    """Two appends, and all of it read back over checked links."""
    rows = read_table(spark, d, "events").select((F.col("event_id") + 1).alias("idx"), F.col("event_type").alias("topic"), F.col("props").alias("payload"))
    store = EventStore(spark)
    store.append(rows.where("idx <= 400"))
    store.append(rows.where("idx > 400"))
    return store.load()


@query("bytes_store", "SRC-19", "SELECT 'o/' || o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 7 <> 0")
def bytes_store(spark: SparkSession, d: str) -> DataFrame:
    """All orders put, a fifth put again, a seventh deleted; what the newest version holds."""
    o = read_table(spark, d, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("key"), F.col("o_orderstatus").cast("binary").alias("value"), "o_orderkey")
    store = BytesStore(spark)
    store.put(o.select("key", "value"))
    store.put(o.where("o_orderkey % 5 = 0").select("key", F.lit("X").cast("binary").alias("value")))
    store.put(o.where("o_orderkey % 7 = 0").select("key", F.lit(None).cast("binary").alias("value")))
    return store.get(store.keys("o/")).select("key", F.col("value").cast("string").alias("value"))


@query("content_range", "SRC-20", "SELECT doc_id, substr(hex(text), 2 * 90 + 1, 2 * 250) AS part FROM documents WHERE strlen(text) > 90")
def content_range(spark: SparkSession, d: str) -> DataFrame:
    parts = chunks(read_table(spark, d, "documents"), "doc_id", "text", 64)
    return read_range(parts, 90, 250, 64).where(F.octet_length("data") > 0).select(F.col("id").alias("doc_id"), F.hex("data").alias("part"))


@query("change_counts", "FN-CNT", f"WITH RECURSIVE {ledgers._replayed(ledgers._LEDGER)} SELECT tx_id, CASE WHEN ok THEN 1 ELSE 0 END AS changes FROM f")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changed rows of each program, counted from 0 at its start; none if it is rejected."""
    p = ledgers.programs(spark, d)
    n = F.size(F.filter("steps", lambda s: s["op"].isin("put", "add", "delete")))
    return p.join(replay.replay(p)[0].select("tx_id", "outcome"), "tx_id").select("tx_id", F.when(F.col("outcome") == "accepted", n).otherwise(0).alias("changes"))


@query("relay_flooding", "SM-17", "WITH RECURSIVE r(frame, peer) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT r.frame, CAST((r.peer * 2) % 7 AS INTEGER) FROM r) SELECT frame, peer FROM r")
def relay_flooding(spark: SparkSession, d: str) -> DataFrame:
    """Which peers a frame reaches when each passes it on once."""
    start = read_table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("frame"), F.col("n_nationkey").alias("peer"))
    return recursion.fixpoint(start, lambda new: new.select("frame", ((F.col("peer") * 2) % 7).cast("int").alias("peer")), max_rounds=12)


@query("time_budget", "PL-07", "SELECT 'step_limit' AS slow, 25 AS quick")
def time_budget(spark: SparkSession, d: str) -> DataFrame:
    """A read that takes 20 s is stopped after one."""

    def linger(batches):
        time.sleep(20)
        yield from batches

    slow_read = read_table(spark, d, "nation").select("n_nationkey").mapInArrow(linger, "n_nationkey int")
    try:
        within(spark, 1.0, slow_read.count)
        slow = "none"
    except Rejected as e:
        slow = e.code
    return spark.createDataFrame([(slow, within(spark, 60, read_table(spark, d, "nation").count))], "slow string, quick long")


sql("ext_generate_series", "SRC-10", "SELECT explode(sequence(1, 20, 3)) AS value", "SELECT unnest(generate_series(1, 20, 3)) AS value")
sql("ext_math", "FN-MATH", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS r, round(ln(o_totalprice), 6) AS l, round(pow(o_orderkey, 0.5), 6) AS p FROM orders")


@query("ext_map_array", "FN-MAP", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def ext_map_array(spark: SparkSession, d: str) -> DataFrame:
    per = read_table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("k"))
    return per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "k"))).alias("m")).select("o_custkey", F.size("m").cast("long").alias("kinds"), F.array_max(F.map_values("m")).alias("last"))


def _round_trip(kind: str, **options: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, rows = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex[:10]}", read_table(spark, d, "customer")
        rows.write.format(kind).options(**options).save(path)
        back = checkpointed(spark.read.format(kind).options(**options).schema(rows.schema).load(path))
        remove_folder(spark, path)
        return back

    return run


for _kind, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {}), ("xml", {"rowTag": "row"})):
    REGISTRY.add(f"ext_format_{_kind}", "SRC-22", _round_trip(_kind, **_options), "SELECT * FROM customer")


@query("ext_sql_function", "UF-01", "SELECT o_orderkey, o_totalprice * 1.19 AS gross FROM orders")
def ext_sql_function(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gross_of(net DOUBLE) RETURNS DOUBLE RETURN net * 1.19D")
    return read_table(spark, d, "orders").select("o_orderkey", F.expr("gross_of(o_totalprice)").alias("gross"))


@query("ext_user_aggregate", "UF-01", "SELECT o_orderstatus, round(sqrt(avg(o_totalprice * o_totalprice)), 2) AS rms, count(*) AS n FROM orders GROUP BY o_orderstatus")
def ext_user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A user aggregate in two phases: Arrow batches to partial sums in the tasks, and their sums after one small shuffle."""
    return aggregates.user_aggregate(read_table(spark, d, "orders"), "o_orderstatus", "o_totalprice", _square_parts, lambda n, s: F.round(F.sqrt(s / n), 2)).select("o_orderstatus", F.col("value").alias("rms"), "n")


def _square_parts(values):
    """(count, sum of squares) of a batch."""
    return len(values), float((values * values).sum())


@query("ext_table_function", "UF-01", "SELECT n_nationkey, CAST(unnest(generate_series(1, n_regionkey)) AS BIGINT) AS step FROM nation")
def ext_table_function(spark: SparkSession, d: str) -> DataFrame:
    read_table(spark, d, "nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION steps_to(top INT) RETURNS TABLE (step BIGINT) RETURN SELECT explode(CASE WHEN top > 0 THEN sequence(1L, CAST(top AS BIGINT)) END)")
    return spark.sql("SELECT n_nationkey, step FROM nation, LATERAL steps_to(n_regionkey)")
