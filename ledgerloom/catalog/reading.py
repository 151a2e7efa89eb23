"""Reads and writes of tables: scans, projections, joins, aggregates, windows, sorting, sets and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.catalog._registry import Registry
from ledgerloom.functions import json_values, scalars
from ledgerloom.operators import recursion, windows, writes
from ledgerloom.sources import tables
from ledgerloom.sources.tables import read_table

REGISTRY = Registry()
sql, query = REGISTRY.sql, REGISTRY.query

# Scans, projections, predicates.

sql("scan_filter_project", "SRC-01 PRJ-01 PRJ-03 PRJ-04 PRJ-12 PRJ-13", """
SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS doubled, l_extendedprice - l_tax AS net
FROM lineitem WHERE l_quantity >= 30 AND (l_returnflag = 'R' OR l_linestatus <> 'O') AND NOT l_discount < 0.05""")
sql("select_star", "PRJ-02", "SELECT * FROM nation")
sql("case_chain", "PRJ-11", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' WHEN o_totalprice > 0 THEN 'small' ELSE 'none' END AS size FROM orders""")
sql("null_safe_compare", "PRJ-05 PRJ-06", """
SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif('F', 'F') AS same_null, nullif(o_orderstatus, 'F') IS NULL AS is_null,
       nullif(o_orderstatus, 'O') IS DISTINCT FROM 'P' AS differs FROM orders""")
sql("in_list", "PRJ-07 PRJ-19", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 150000")
sql("in_subquery", "PRJ-08 JN-04", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql("not_in_subquery", "PRJ-08 JN-05", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
sql("exists_semi", "PRJ-09 JN-04", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
sql("not_exists_anti", "PRJ-09 JN-05", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_discount > 0.05 AND l.l_quantity > 25)")
sql("scalar_subquery", "PRJ-10", """
SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS dearest,
       c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer c""")
sql("integer_division", "PRJ-14", "SELECT o_orderkey, o_orderkey div 7 AS quotient, o_orderkey % 7 AS remainder, -o_orderkey % 7 AS negative FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS quotient, o_orderkey % 7 AS remainder, -o_orderkey % 7 AS negative FROM orders")
sql("bit_operations", "PRJ-15", "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 1024 AS flagged, shiftleft(o_orderkey, 3) AS up, shiftright(o_orderkey, 2) AS down, ~o_orderkey AS inverted FROM orders",
    "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 1024 AS flagged, o_orderkey << 3 AS up, o_orderkey >> 2 AS down, ~o_orderkey AS inverted FROM orders")
sql("concatenation", "PRJ-16", "SELECT c_custkey, c_name || ':' || c_mktsegment AS label, c_name || nullif(c_mktsegment, 'BUILDING') AS maybe FROM customer")
sql("row_values", "PRJ-23", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('A', 'F')) AND (l_linenumber, l_suppkey) = (1, l_suppkey)")
sql("typed_literals", "PRJ-25 SRC-07", "SELECT col1 AS k, col2 AS r FROM VALUES (1, 1.5D), (2, 2.0D) AS t(col1, col2)", "SELECT col1 AS k, CAST(col2 AS DOUBLE) AS r FROM (VALUES (1, 1.5), (2, 2.0)) AS t(col1, col2)")
sql("bound_parameters", "PRJ-24", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'", least=250000, status="F")
sql("partial_predicate", "PRJ-27", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL")
sql("derived_table", "PRJ-31", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE n > 10")
sql("generated_column", "PRJ-29", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")


@query("like_nocase", "PRJ-17", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g' OR c_name LIKE '%#___0_1'")
def like_nocase(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").where(scalars.like(F.col("c_mktsegment"), "b%g") | scalars.like(F.col("c_name"), "%#___0_1")).select("c_custkey")


@query("glob_match", "PRJ-18", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_brand, '^Brand#[12].*$')")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").where(scalars.glob(F.col("p_brand"), "Brand#[12]*")).select("p_partkey", "p_name")


@query("cast_prefix", "PRJ-20", "SELECT p_partkey, CAST(coalesce(nullif(regexp_extract(p_name, '^\\s*([+-]?[0-9]{1,18})', 1), ''), '0') AS BIGINT) AS n, CAST(p_size AS VARCHAR) AS s, try_cast(p_brand AS INTEGER) AS nothing FROM part")
def cast_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", scalars.cast_integer(F.col("p_name")).alias("n"), F.col("p_size").cast("string").alias("s"), F.col("p_brand").try_cast("int").alias("nothing"))


@query("collations", "PRJ-21", "SELECT lower(o_orderpriority) AS p, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE rtrim(o_orderstatus || '  ') = 'F' GROUP BY 1")
def collations(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "orders").where(F.collate(F.concat("o_orderstatus", F.lit("  ")), "UTF8_BINARY_RTRIM") == F.collate(F.lit("F"), "UTF8_BINARY_RTRIM"))
    return df.groupBy(F.collate("o_orderpriority", "UTF8_LCASE").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")).select(F.collate(F.lower("k"), "UTF8_BINARY").alias("p"), "n", "first")


sql("affinity_join", "PRJ-22 JN-10", """
SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN (SELECT CAST(c_custkey AS STRING) AS code, c_custkey FROM customer) c
ON CAST(c.code AS BIGINT) = o.o_custkey""", """
SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN (SELECT CAST(c_custkey AS VARCHAR) AS code, c_custkey FROM customer) c
ON CAST(c.code AS BIGINT) = o.o_custkey""")


@query("explain_plan", "PRJ-26 AG-19", "SELECT * FROM (VALUES ('aggregate', 2), ('exchange', 1), ('filter', 1), ('scan', 1)) AS t(operator, n)")
def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    """The operators of the plan that EXPLAIN prints for a filtered aggregate: partial and final aggregates around one exchange."""
    read_table(spark, d, "orders").createOrReplaceTempView("orders")
    said = spark.sql("EXPLAIN FORMATTED SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100 GROUP BY o_orderstatus")
    names = {"HashAggregate": "aggregate", "Exchange": "exchange", "Filter": "filter", "Scan parquet": "scan"}
    lines = said.select(F.explode(F.split("plan", "\n")).alias("line")).where(F.col("line").rlike("^\\([0-9]+\\) "))
    found = F.lit(None).cast("string")
    for k, v in names.items():
        found = F.when(F.col("line").contains(k), v).otherwise(found)
    return lines.select(found.alias("operator")).where("operator IS NOT NULL").groupBy("operator").agg(F.count("*").cast("int").alias("n"))


@query("constraint_violations", "PRJ-28 OW-17", """
WITH x AS (SELECT o_orderkey % 5000 AS k, nullif(o_orderstatus, 'P') AS s, o_totalprice AS p, o_custkey * 2 AS c FROM orders)
SELECT * FROM (
  SELECT 'unique:k' AS "constraint", (SELECT count(*) FROM (SELECT k FROM x WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)) AS n
  UNION ALL SELECT 'not_null:s', (SELECT count(*) FROM x WHERE s IS NULL)
  UNION ALL SELECT 'check:cheap', (SELECT count(*) FROM x WHERE NOT (p < 400000))
  UNION ALL SELECT 'foreign_key:c', (SELECT count(*) FROM x WHERE c IS NOT NULL AND c NOT IN (SELECT c_custkey FROM customer))) WHERE n > 0""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("k"), F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_totalprice").alias("p"), (F.col("o_custkey") * 2).alias("c"))
    return writes.violations(x, unique=[["k"]], not_null=["s"], checks={"cheap": "p < 400000"}, foreign=[(["c"], read_table(spark, d, "customer"), ["c_custkey"])])


@query("column_defaults", "PRJ-30 SNK-01", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders UNION ALL SELECT 10000000 + c_custkey, c_custkey, 'N', 0.0, NULL FROM customer WHERE c_custkey % 10 = 0")
def column_defaults(spark: SparkSession, d: str) -> DataFrame:
    base = read_table(spark, d, "orders").drop("o_orderdate")
    new = read_table(spark, d, "customer").where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))
    return writes.insert(base, new, {"o_orderstatus": F.lit("N"), "o_totalprice": F.lit(0.0)})


# Metadata.

@query("table_info", "SRC-04 SRC-05", """
SELECT * FROM (VALUES ('nation', 0, 'n_nationkey', 'int', 1), ('nation', 1, 'n_name', 'string', 0), ('nation', 2, 'n_regionkey', 'int', 0)) AS t(table_name, cid, name, type, pk)""")
def table_info(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_info(read_table(spark, d, "nation"), "nation", tables.KEYS["nation"]).drop("not_null")


@query("foreign_key_list", "SRC-05", """
SELECT * FROM (VALUES ('nation', 0, 'region', 'n_regionkey', 'r_regionkey'), ('customer', 0, 'nation', 'c_nationkey', 'n_nationkey'), ('supplier', 0, 'nation', 's_nationkey', 'n_nationkey'),
 ('orders', 0, 'customer', 'o_custkey', 'c_custkey'), ('lineitem', 0, 'orders', 'l_orderkey', 'o_orderkey'), ('lineitem', 1, 'part', 'l_partkey', 'p_partkey'), ('lineitem', 2, 'supplier', 'l_suppkey', 's_suppkey')) AS t(child, id, parent, child_column, parent_column)""")
def foreign_key_list(spark: SparkSession, d: str) -> DataFrame:
    return tables.foreign_key_list(spark)


_KEY_COLUMNS = [(t, f"pk_{t}", i, c) for t in tables.TABLES for i, c in enumerate(tables.KEYS.get(t, ()))]


@query("index_list", "SRC-05", "SELECT * FROM (VALUES " + ", ".join(map(str, _KEY_COLUMNS)) + ") AS t(table_name, index_name, seqno, column_name)")
def index_list(spark: SparkSession, d: str) -> DataFrame:
    return tables.index_list(spark)


@query("table_list", "SRC-05", "SELECT table_name AS name, CAST(count(*) AS INTEGER) AS ncol FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in tables.TABLES) + ") GROUP BY table_name")
def table_list(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_list(spark, d)


@query("quick_check", "SRC-05", "SELECT 'repeated key' AS problem, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def quick_check(spark: SparkSession, d: str) -> DataFrame:
    return tables.quick_check(read_table(spark, d, "lineitem"), ["l_orderkey"])


_CORE_FUNCTIONS = ("abs", "avg", "coalesce", "count", "lag", "lower", "max", "rank", "round", "sum")


@query("function_list", "SRC-06", "SELECT * FROM (VALUES " + ", ".join(f"('{f}')" for f in _CORE_FUNCTIONS) + ") AS t(function)")
def function_list(spark: SparkSession, d: str) -> DataFrame:
    """Of the engine's functions those that every dialect of the surface has."""
    return spark.sql("SHOW SYSTEM FUNCTIONS").where(F.col("function").isin(*_CORE_FUNCTIONS))


@query("values_table", "SRC-07", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(column1, column2)")
def values_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.values(spark, [(1, "a"), (2, "b")], ["int", "string"])


@query("seed_rows", "SRC-21", "SELECT s_suppkey, s_nationkey, CAST(dense_rank() OVER (ORDER BY s_nationkey) AS INTEGER) AS owner FROM supplier")
def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, in the order of their keys dealt into seeds of as many rows as one may have."""
    supplier = writes.with_row_ids(read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"], -1, "__n").withColumn("seed", F.floor(F.col("__n") / tables.MAX_SEED_ROWS))
    nations = supplier.select(F.col("s_nationkey").alias("key")).distinct().withColumn("id", F.dense_rank().over(Window.orderBy("key")))  # 25 nations
    return tables.seed_rows(supplier, nations, owner_key="s_nationkey", seed="seed").select("s_suppkey", "s_nationkey", "owner")


sql("view_scan", "SRC-14", "SELECT n_name, r_name FROM (SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) v WHERE r_name <> 'ASIA'")

# Joins.

sql("inner_join_multi", "JN-01", """
SELECT r.r_name, n.n_name, count(*) AS n_suppliers FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""")
sql("left_join", "JN-02", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
sql("cross_join", "JN-03", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
sql("theta_join", "JN-06", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (a.n_regionkey = b.n_regionkey OR b.n_nationkey = 24)")
sql("natural_join", "JN-07", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
sql("using_join", "JN-07", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
sql("right_join", "JN-08", "SELECT n.n_name, s.s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql("full_join", "JN-08", """
SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k""")
sql("self_join", "JN-09", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("lateral_join", "JN-14", "SELECT n.n_name, t.s_suppkey FROM nation n, LATERAL (SELECT s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) t")

# Aggregates.

sql("group_agg", "AG-01 AG-02 AG-08", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
sql("avg_minmax", "AG-04 AG-05 AG-08", "SELECT o_orderstatus AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS p FROM orders GROUP BY 1")
sql("having", "AG-09", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("distinct_agg", "AG-10", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderpriority) AS prios FROM orders GROUP BY o_orderstatus")
sql("filter_agg", "AG-11", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS o FROM orders GROUP BY o_orderpriority")
sql("max_by_bare", "AG-13", "SELECT o_custkey, max(o_orderkey) AS last, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_orderkey) AS last, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
sql("select_distinct", "AG-14", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("global_agg", "AG-15 AG-01", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'P')) AS not_p, max(o_orderkey) AS top FROM orders")
sql("group_by_expression", "AG-08", "SELECT o_orderkey % 10 AS digit, count(*) AS n FROM orders GROUP BY o_orderkey % 10")
sql("ext_rollup", "AG-17", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("ext_cube", "AG-17", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("ext_grouping_sets", "AG-17", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("total_agg", "AG-03", "SELECT o_orderstatus, round(coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0.0), 2) AS nothing, round(coalesce(sum(o_totalprice), 0.0), 2) AS all_prices FROM orders GROUP BY o_orderstatus")
def total_agg(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(scalars.total(F.when(p < 0, p)), 2).alias("nothing"), F.round(scalars.total(p), 2).alias("all_prices"))


@query("listagg_ordered", "AG-06 AG-12", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names, string_agg(DISTINCT substr(n_name, 1, 1), ',' ORDER BY substr(n_name, 1, 1)) AS initials FROM nation GROUP BY n_regionkey")
def listagg_ordered(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "nation").withColumn("i", F.substring("n_name", 1, 1))
    return df.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"), scalars.group_concat(F.col("i"), ",", distinct=True).alias("initials"))


@query("json_group_array", "AG-07", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey")
def json_group_array(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").groupBy("n_regionkey").agg(json_values.group_array(F.col("n_name"), F.col("n_nationkey")).alias("names"), json_values.group_object(F.col("n_name"), F.col("n_nationkey")).alias("keys"))


@query("ext_approx_distinct", "AG-18", "SELECT o_orderstatus, true AS custs_near, true AS middle_near, round(stddev(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderstatus")
def ext_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Sketches beside what they estimate: distinct counts within 15 %, the median's rank within 2 %."""
    p = F.col("o_totalprice")
    orders = read_table(spark, d, "orders")
    per = orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey").alias("custs"), F.percentile_approx("o_totalprice", 0.5).alias("middle"), F.round(F.stddev(p), 2).alias("spread"))
    exact = orders.join(per, "o_orderstatus").groupBy("o_orderstatus", "spread").agg(F.count_distinct("o_custkey").alias("n"), F.first("custs").alias("custs"), F.avg((p <= F.col("middle")).cast("double")).alias("share"))
    return exact.select("o_orderstatus", (F.abs(F.col("custs") - F.col("n")) <= 0.15 * F.col("n") + 1).alias("custs_near"), (F.abs(F.col("share") - 0.5) <= 0.02).alias("middle_near"), "spread")


# Windows.

sql("win_rank_family", "WN-01 WN-02 WN-03 WN-07", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)""")


@query("win_rank_of_groups", "WN-02", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM orders GROUP BY o_custkey")
def win_rank_of_groups(spark: SparkSession, d: str) -> DataFrame:
    per = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return windows.with_global_rank(per.withColumn("least", -F.col("n")), ["least"], "rk").drop("least")


sql("win_lag_lead", "WN-04", "SELECT event_id, lag(event_id, 2, -1) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "SELECT event_id, lag(event_id, 2, -1) OVER w AS \"before\", lead(event_id) OVER w AS \"after\" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
sql("win_nth", "WN-05", """
SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 3) OVER w AS third
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
sql("win_rows", "WN-06 WN-08 WN-13", "SELECT event_id, round(sum(value) OVER w, 4) AS s, count(*) OVER w AS n, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
sql("win_range", "WN-09", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 50 FOLLOWING) AS near FROM events")


@query("win_groups", "WN-10", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def win_groups(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    out = windows.with_groups_frame(df, "s", F.sum("value"), partition=["user_id"], order=["event_type"], before=1, after=0)
    return out.select("event_id", F.round("s", 4).alias("s"))


_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query("win_exclude", "WN-11", f"""SELECT event_id, sum(v) OVER (PARTITION BY user_id ORDER BY event_type {_ALL} EXCLUDE CURRENT ROW) AS no_row,
sum(v) OVER (PARTITION BY user_id ORDER BY event_type {_ALL} EXCLUDE GROUP) AS no_group, sum(v) OVER (PARTITION BY user_id ORDER BY event_type {_ALL} EXCLUDE TIES) AS no_ties
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events)""".replace("sum(v)", "CAST(sum(v)").replace(") AS no_", ") AS BIGINT) AS no_"))
def win_exclude(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    made = {n: windows.sum_excluding(F.col("v"), w, partition=["user_id"], order=["event_type"], first=Window.unboundedPreceding, last=Window.unboundedFollowing) for n, w in (("no_row", "current row"), ("no_group", "group"), ("no_ties", "ties"))}
    return df.select("event_id", *(c.alias(n) for n, c in made.items()))


@query("win_filter", "WN-12", "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS clicks, round(sum(value) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS large FROM events")
def win_filter(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read_table(spark, d, "events").select("event_id", windows.count_where(F.col("event_type") == "click", w).alias("clicks"), F.round(windows.sum_where(F.col("value"), F.col("value") > 50, w), 4).alias("large"))


sql("ext_win_ignore_nulls", "WN-14", "SELECT event_id, last_value(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS last_other FROM events", "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_other FROM events")
sql("ext_asof_join", "JN-15", "SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")

# Sorting and sets.

sql("limit_offset", "ST-04", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
sql("order_by", "ST-01 ST-02 ST-03", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY 2 DESC NULLS LAST, o_totalprice + 1, 1")
sql("bytewise_sort", "ST-06", "SELECT c_name FROM customer ORDER BY c_mktsegment, c_name")
sql("topk", "ST-04 ST-05", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("union_all", "SO-01", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
sql("union_distinct", "SO-02", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect_rows", "SO-03", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
sql("except_rows", "SO-03", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
sql("common_table_expression", "SO-04", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS custs FROM per GROUP BY n")
sql("recursive_cte", "SO-05 JN-13", "WITH RECURSIVE walk(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 24 UNION ALL SELECT CAST(k - 3 AS INT), depth + 1 FROM walk WHERE k >= 3) SELECT k, depth FROM walk")


@query("recursive_union_fixpoint", "SO-06", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 11 FROM r) SELECT CAST(k AS BIGINT) AS k FROM r")
def recursive_union_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return recursion.fixpoint(spark.createDataFrame([(1,)], "k long"), lambda new: new.select(((F.col("k") * 3) % 11).alias("k")), max_rounds=20)


@query("recursion_budget", "SO-07", "SELECT 'step_limit' AS outcome")
def recursion_budget(spark: SparkSession, d: str) -> DataFrame:
    try:
        recursion.fixpoint(spark.createDataFrame([(1,)], "k long"), lambda new: new.select((F.col("k") + 1).alias("k")), max_rounds=3)
    except recursion.StepLimit as e:
        return spark.createDataFrame([(e.code,)], "outcome string")
    raise AssertionError("an endless recursion ended")


# Writes; each result is the table's next state.

_BASE = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders"
_DELTA = "SELECT o_orderkey + 3 AS k, o_custkey AS c, 'X' AS s, o_totalprice + 1 AS p FROM orders WHERE o_orderkey % 3 = 0"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).where("k % 3 = 0").select((F.col("k") + 3).alias("k"), "c", F.lit("X").alias("s"), (F.col("p") + 1).alias("p"))


@query("insert_select", "SNK-01", f"{_BASE} UNION ALL SELECT k + 100000000, c, s, p FROM ({_DELTA})")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    return writes.insert(_base(spark, d), _delta(spark, d).withColumn("k", F.col("k") + 100_000_000))


@query("update_where", "SNK-02", f"SELECT k, c, CASE WHEN p > 200000 THEN 'B' ELSE s END AS s, CASE WHEN p > 200000 THEN p - 10 ELSE p END AS p FROM ({_BASE})")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    return writes.update(_base(spark, d), F.col("p") > 200000, {"s": F.lit("B"), "p": F.col("p") - 10})


@query("delete_where", "SNK-03", f"SELECT * FROM ({_BASE}) WHERE NOT (p < 50000 AND s = 'F')")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    return writes.delete(_base(spark, d), (F.col("p") < 50000) & (F.col("s") == "F"))


@query("replace_rows", "SNK-04", f"SELECT * FROM ({_BASE}) WHERE k NOT IN (SELECT k FROM ({_DELTA})) UNION ALL SELECT * FROM ({_DELTA})")
def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    return writes.replace(_base(spark, d), _delta(spark, d), ["k"], ["p"])


@query("upsert_merge", "SNK-05", f"SELECT coalesce(b.k, d.k) AS k, coalesce(b.c, d.c) AS c, CASE WHEN b.k IS NOT NULL AND d.k IS NOT NULL AND d.p > b.p THEN d.s WHEN b.k IS NOT NULL THEN b.s ELSE d.s END AS s, CASE WHEN b.k IS NOT NULL AND d.k IS NOT NULL AND d.p > b.p THEN b.p + d.p WHEN b.k IS NOT NULL THEN b.p ELSE d.p END AS p FROM ({_BASE}) b FULL OUTER JOIN ({_DELTA}) d ON b.k = d.k")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return writes.upsert(_base(spark, d), _delta(spark, d), ["k"], {"s": "excluded.s", "p": "old.p + excluded.p"}, where="excluded.p > old.p")


@query("insert_or_ignore", "SNK-06", f"{_BASE} UNION ALL SELECT * FROM ({_DELTA}) WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    return writes.insert_or_ignore(_base(spark, d), _delta(spark, d), ["k"], ["p"])


@query("returning_rows", "SNK-07", f"SELECT k, 'update' AS change FROM ({_BASE}) WHERE p > 200000")
def returning_rows(spark: SparkSession, d: str) -> DataFrame:
    before = _base(spark, d)
    return writes.changed_rows(before, writes.update(before, F.col("p") > 200000, {"p": F.col("p") - 10}), ["k"])


@query("ddl_views", "SNK-08", "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders")
def ddl_views(spark: SparkSession, d: str) -> DataFrame:
    """Add, rename and drop of columns, as a view over the table."""
    read_table(spark, d, "orders").drop("o_orderdate").withColumnRenamed("o_orderkey", "id").withColumn("note", F.lit(None).cast("string")).drop("o_orderpriority").createOrReplaceTempView("ddl_orders")
    return spark.table("ddl_orders")


@query("analyze_table", "SNK-09", "SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_custkeys, count(*) - count(o_custkey) AS n_null FROM orders")
def analyze_table(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_custkeys"), (F.count("*") - F.count("o_custkey")).alias("n_null")).select(F.lit("orders").alias("table_name"), "*")


@query("autoincrement_ids", "SNK-10", "SELECT c_custkey, c_mktsegment, 500 + row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS id FROM customer")
def autoincrement_ids(spark: SparkSession, d: str) -> DataFrame:
    return writes.with_row_ids(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], 500, "id")


@query("update_from", "SNK-11", f"SELECT b.k, b.c, CASE WHEN d.k IS NOT NULL THEN d.s ELSE b.s END AS s, CASE WHEN d.k IS NOT NULL THEN b.p + d.p ELSE b.p END AS p FROM ({_BASE}) b LEFT JOIN ({_DELTA}) d ON b.k = d.k")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    return writes.update_from(_base(spark, d), _delta(spark, d), ["k"], {"s": "src.s", "p": "old.p + src.p"})


@query("delete_limited", "SNK-11", f"SELECT * FROM ({_BASE}) WHERE k NOT IN (SELECT k FROM ({_BASE}) WHERE s = 'F' ORDER BY p DESC, k LIMIT 25)")
def delete_limited(spark: SparkSession, d: str) -> DataFrame:
    return writes.delete_limited(_base(spark, d), F.col("s") == "F", [F.col("p").desc(), F.col("k")], 25, ["k"])


REGISTRY.add("flagship_accepted_by_type", "LG-05 AG-02 WN-01", lambda spark, d: flagship(spark, d), """
SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (
  SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1 GROUP BY event_type ORDER BY event_type""")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Accepted events by type: the first of each (author, operation) counts, later ones conflict."""
    w = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    first = read_table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).orderBy("event_type")
