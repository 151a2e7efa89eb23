"""Ownership, grants, collectives, closures and transfers over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog._registry import Registry
from ledgerloom.ledger import ownership as own
from ledgerloom.operators import recursion
from ledgerloom.sources.tables import FOREIGN_KEYS, TABLES, read_table

REGISTRY = Registry()
query = REGISTRY.query

# Nations are collectives, customers members; the role comes from the market segment.
_ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'member' ELSE 'reader' END"
_MEMBERS = f"SELECT 'n' || c_nationkey AS collective, CAST(c_custkey AS VARCHAR) AS member, {_ROLE} AS role FROM customer WHERE c_custkey % 5 <> 0"


def _members(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "member").otherwise("reader")
    return c.select(F.concat(F.lit("n"), "c_nationkey").alias("collective"), F.col("c_custkey").cast("string").alias("member"), role.alias("role"), F.when(F.col("c_custkey") % 5 == 0, "left").otherwise("active").alias("state"), F.lit(1).alias("joined_tx"), F.lit(None).cast("long").alias("left_tx"))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    nations = read_table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("collective"), F.lit("member").alias("insert_role"), F.lit("admin").alias("update_role"), F.lit("admin").alias("delete_role"))
    actors = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("actor"))
    return own.actor_owners(actors, _members(spark, d), nations)


_OWNERS = f"""SELECT CAST(c_custkey AS VARCHAR) AS actor, CAST(c_custkey AS VARCHAR) AS owner, op FROM customer, (VALUES ('insert'), ('update'), ('delete')) AS o(op)
UNION ALL SELECT member, collective, op FROM ({_MEMBERS}), (VALUES ('insert'), ('update'), ('delete')) AS o(op) WHERE role = 'admin' OR (role = 'member' AND op = 'insert')"""


@query("owner_view", "OW-01 SRC-03", _OWNERS)
def owner_view(spark: SparkSession, d: str) -> DataFrame:
    return _owners(spark, d)


def _grants(spark: SparkSession, d: str) -> DataFrame:
    """Supplier k's grants to the customers of its number's multiples, on orders."""
    c = read_table(spark, d, "customer").where("c_custkey % 3 = 0")
    return c.select(F.col("c_custkey").alias("grant_id"), F.lit("orders").alias("tbl"), F.col("c_custkey").cast("string").alias("grantor"), (F.col("c_custkey") + 1).cast("string").alias("grantee"), F.lit(None).cast("string").alias("row_key"), F.lit(False).alias("op_insert"), F.lit(True).alias("op_update"), F.lit(False).alias("op_delete"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("o_orderstatus"))).alias("columns"), (F.col("c_custkey") % 100).alias("created_tx"), F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey") % 100 + 50).alias("revoked_tx"))


@query("grants_live", "OW-02 OW-08", "SELECT c_custkey AS grant_id, CAST(c_custkey + 1 AS VARCHAR) AS grantee FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 100 <= 60 AND (c_custkey % 9 <> 0 OR c_custkey % 100 + 50 > 60)")
def grants_live(spark: SparkSession, d: str) -> DataFrame:
    return own.live_grants(_grants(spark, d), 60).select("grant_id", "grantee")


def _writes(spark: SparkSession, d: str) -> DataFrame:
    """Updates of orders: every order by its customer, or by the next one; some change the owner, some another column."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("tx_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string").alias("actor"), F.lit("update").alias("op"), F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderkey").cast("string").alias("row_key"),
        F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_totalprice"))).alias("changed"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("-1")).alias("new_owner"))


_CHECKED = """SELECT o_orderkey AS tx_id, o_custkey AS c, (o_orderkey % 2 = 0 OR (o_custkey % 3 = 0 AND o_custkey % 9 <> 0 AND (o_custkey % 2 = 1 OR o_orderkey % 4 = 1))) AND o_orderkey % 10 <> 0 AS allowed FROM orders"""


@query("owner_check_update", "OW-04 OW-06", f"SELECT tx_id, allowed FROM ({_CHECKED})")
def owner_check_update(spark: SparkSession, d: str) -> DataFrame:
    return own.check_writes(_writes(spark, d), _owners(spark, d), own.live_grants(_grants(spark, d)), "orders").select("tx_id", "allowed")


@query("owner_statement_outcomes", "OW-07 FN-04 PL-11", f"SELECT c AS tx_id, CASE WHEN bool_and(allowed) THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN NOT bool_and(allowed) THEN 'policy:orders:update' END AS rejection_code FROM ({_CHECKED}) GROUP BY c")
def owner_statement_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One statement for each customer's orders: a single refused row rejects it."""
    checked = own.check_writes(_writes(spark, d), _owners(spark, d), own.live_grants(_grants(spark, d)), "orders")
    return own.statement_outcomes(checked.withColumn("tx_id", F.col("owner").cast("long")), "orders")


def _row_grants(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's grant to the next one: of inserts if its number is even, of deletes if it is a multiple of 3; multiples of 5 are revoked."""
    k = F.col("c_custkey")
    return read_table(spark, d, "customer").select(k.alias("grant_id"), F.lit("orders").alias("tbl"), k.cast("string").alias("grantor"), (k + 1).cast("string").alias("grantee"), F.lit(None).cast("string").alias("row_key"), (k % 2 == 0).alias("op_insert"), F.lit(False).alias("op_update"), (k % 3 == 0).alias("op_delete"),
        F.lit(None).cast("array<string>").alias("columns"), F.lit(1).cast("long").alias("created_tx"), F.when(k % 5 == 0, F.lit(2).cast("long")).alias("revoked_tx"))


def _tries(spark: SparkSession, d: str, op: str) -> DataFrame:
    """Every customer writes a row of its own, one of its nation, one of the customer before it, and one of a stranger."""
    c = read_table(spark, d, "customer")
    k = F.col("c_custkey")
    owners = F.posexplode(F.array(k.cast("string"), F.concat(F.lit("n"), "c_nationkey"), (k - 1).cast("string"), F.lit("stranger")))
    return c.select(k, owners.alias("n", "owner")).select((k * 4 + F.col("n")).cast("long").alias("tx_id"), k.cast("string").alias("actor"), F.lit(op).alias("op"), "owner", F.concat_ws("/", k, "n").alias("row_key"), F.array().cast("array<string>").alias("changed"), F.lit(None).cast("string").alias("new_owner"))


def _tries_sql(role: str, grant: str) -> str:
    return f"""SELECT CAST(c_custkey * 4 + n AS BIGINT) AS tx_id, CASE n WHEN 0 THEN true WHEN 1 THEN c_custkey % 5 <> 0 AND ({role}) WHEN 2 THEN ({grant}) AND (c_custkey - 1) % 5 <> 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) ELSE false END AS allowed
FROM customer, (VALUES (0), (1), (2), (3)) AS t(n)"""


_INSERTS = _tries_sql("c_mktsegment IN ('BUILDING', 'MACHINERY')", "(c_custkey - 1) % 2 = 0")
_DELETES = _tries_sql("c_mktsegment = 'BUILDING'", "(c_custkey - 1) % 3 = 0")


@query("owner_check_insert", "OW-03", _INSERTS)
def owner_check_insert(spark: SparkSession, d: str) -> DataFrame:
    return own.check_writes(_tries(spark, d, "insert"), _owners(spark, d), own.live_grants(_row_grants(spark, d)), "orders").select("tx_id", "allowed")


@query("owner_check_seed", "OW-03 OW-19", "SELECT CAST(c_custkey * 4 + n AS BIGINT) AS tx_id, true AS allowed FROM customer, (VALUES (0), (1), (2), (3)) AS t(n)")
def owner_check_seed(spark: SparkSession, d: str) -> DataFrame:
    """Inserts while the seeding window is open: rows of any owner."""
    return own.check_writes(_tries(spark, d, "insert"), _owners(spark, d), own.live_grants(_row_grants(spark, d)), "orders", seeding=True).select("tx_id", "allowed")


@query("owner_check_delete", "OW-05", _DELETES)
def owner_check_delete(spark: SparkSession, d: str) -> DataFrame:
    return own.check_writes(_tries(spark, d, "delete"), _owners(spark, d), own.live_grants(_row_grants(spark, d)), "orders").select("tx_id", "allowed")


@query("owner_check_replace", "OW-03 OW-05 OW-07 SNK-04", f"SELECT tx_id, i.allowed AND d.allowed AS allowed FROM ({_INSERTS}) i JOIN ({_DELETES}) d USING (tx_id)")
def owner_check_replace(spark: SparkSession, d: str) -> DataFrame:
    """REPLACE of existing rows: a delete and an insert, each of which must be allowed, so it is no way around either check."""
    tries = _tries(spark, d, "replace").withColumn("old_owner", F.col("owner"))
    return own.check_replaces(tries, _owners(spark, d), own.live_grants(_row_grants(spark, d)), "orders").select("tx_id", "allowed")


@query("grant_column_cap", "OW-06", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey % 3 = 0")
def grant_column_cap(spark: SparkSession, d: str) -> DataFrame:
    before = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    after = before.select(k, F.when((k % 2 == 0) & (k % 3 != 0), "~").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when((k % 2 == 1) & (k % 3 != 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return own.changed_columns(before, after, ["o_orderkey"]).select("o_orderkey", F.array_join("changed", ",").alias("changed"))


@query("grant_revocation", "OW-08", "SELECT c_custkey AS grant_id, CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 100 + 50 WHEN c_custkey % 6 = 0 THEN 7 END AS revoked_tx FROM customer WHERE c_custkey % 3 = 0")
def grant_revocation(spark: SparkSession, d: str) -> DataFrame:
    grants = _grants(spark, d)
    asks = grants.where("grant_id % 6 = 0").select("grant_id", F.col("grantor").alias("actor"), F.lit(7).cast("long").alias("tx")).unionByName(grants.select("grant_id", F.lit("nobody").alias("actor"), F.lit(1).cast("long").alias("tx")))
    return own.revoke(grants, asks).select("grant_id", "revoked_tx")


_CHANGES = "SELECT user_id % 20 AS collective, user_id AS member, CASE WHEN event_type = 'purchase' THEN 'leave' ELSE 'set' END AS action, CASE WHEN event_type = 'click' THEN 'admin' ELSE 'member' END AS role, event_id AS tx FROM events"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select((F.col("user_id") % 20).alias("collective"), F.col("user_id").alias("member"), F.when(F.col("event_type") == "purchase", "leave").otherwise("set").alias("action"), F.when(F.col("event_type") == "click", "admin").otherwise("member").alias("role"), F.col("event_id").alias("tx"))


@query("membership_state", "OW-09", f"SELECT collective, member, arg_max(role, tx) AS role, CASE WHEN arg_max(action, tx) = 'leave' THEN 'left' ELSE 'active' END AS state FROM ({_CHANGES}) GROUP BY collective, member")
def membership_state(spark: SparkSession, d: str) -> DataFrame:
    return own.membership_state(_changes(spark, d))


@query("last_admin_rule", "OW-09", f"SELECT collective FROM (SELECT member // 3 AS collective, member, arg_max(role, tx) AS role, arg_max(action, tx) AS action FROM ({_CHANGES}) GROUP BY 1, member) GROUP BY collective HAVING count(*) FILTER (WHERE role = 'admin' AND action <> 'leave') = 0")
def last_admin_rule(spark: SparkSession, d: str) -> DataFrame:
    """Collectives of three users each."""
    return own.without_admin(own.membership_state(_changes(spark, d).withColumn("collective", F.floor(F.col("member") / 3))))


def _closure(spark: SparkSession, d: str, customers: DataFrame) -> DataFrame:
    roots = customers.select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("key"))
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("parent_key"), F.col("o_orderkey").cast("string").alias("child_key"))
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent_key"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("child_key"))
    return recursion.dependency_closure(roots, [("customer", "orders", orders), ("orders", "lineitem", lines)])


@query("fk_closure", "JN-11 OW-10", """
SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer))""")
def fk_closure(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark, d, read_table(spark, d, "customer"))


@query("fk_topological", "JN-12 OW-18", "SELECT true AS parents_first, 1 AS problems")
def fk_topological(spark: SparkSession, d: str) -> DataFrame:
    order = recursion.parents_first({t: [p for _, p, _ in FOREIGN_KEYS.get(t, ())] for t in TABLES})
    fine = all(order.index(p) < order.index(t) for t in TABLES for _, p, _ in FOREIGN_KEYS.get(t, ()))
    return spark.createDataFrame([(fine, len(own.foreign_key_problems([("a", "cascade", "cascade"), ("b", "no action", "set null")])))], "parents_first boolean, problems int")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_key"), F.col("o_custkey").cast("string").alias("owner"), F.col("o_orderstatus").alias("content"))


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("offer_id"), F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_key"))


_DIGEST = "SELECT o_custkey AS offer_id, sha256(string_agg('orders|' || o_orderkey || '|' || o_orderstatus, chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_custkey"


@query("transfer_digest", "OW-10 AG-16 ST-06", _DIGEST)
def transfer_digest(spark: SparkSession, d: str) -> DataFrame:
    return own.scope_digest(_rows(spark, d), _scope(spark, d))


def _offers(spark: SparkSession, d: str) -> DataFrame:
    made = own.scope_digest(_rows(spark, d), _scope(spark, d))
    k = F.col("offer_id")
    return made.select(k, F.lit("orders").alias("tbl"), F.lit(None).cast("string").alias("row_key"), k.cast("string").alias("from_owner"), (k + 1).cast("string").alias("to_owner"), F.when(k % 3 == 0, "-").otherwise(F.col("digest")).alias("scope_digest"), F.when(k % 4 == 0, "closed").otherwise("open").alias("state"))


_ACCEPTED = "SELECT offer_id, CASE WHEN offer_id % 4 = 0 THEN 'platform:offer_closed' WHEN offer_id % 7 = 0 THEN 'platform:not_addressee' WHEN offer_id % 3 = 0 THEN 'platform:offer_stale' ELSE 'accepted' END AS outcome FROM (SELECT DISTINCT o_custkey AS offer_id FROM orders)"


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    offers = _offers(spark, d)
    k = F.col("offer_id")
    accepts = offers.select(k, F.when(k % 7 == 0, "nobody").otherwise(F.col("to_owner")).alias("actor"))
    return own.accept_transfers(offers, own.scope_digest(_rows(spark, d), _scope(spark, d)), accepts)


@query("transfer_accept", "OW-10", _ACCEPTED)
def transfer_accept(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)


@query("transfer_apply", "OW-11 OW-12", f"SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN a.outcome = 'accepted' THEN CAST(o_custkey + 1 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS owner FROM orders LEFT JOIN ({_ACCEPTED}) a ON a.offer_id = o_custkey")
def transfer_apply(spark: SparkSession, d: str) -> DataFrame:
    return own.apply_transfers(_rows(spark, d), _scope(spark, d), _accepted(spark, d), _offers(spark, d)).select("row_key", "owner")


@query("transfer_completeness", "OW-12", "SELECT o_custkey AS offer_id, CAST(o_orderkey AS VARCHAR) AS row_key FROM orders WHERE o_orderkey % 6 = 0")
def transfer_completeness(spark: SparkSession, d: str) -> DataFrame:
    scope = _scope(spark, d)
    return own.incomplete_transfers(scope.where("cast(row_key as long) % 6 <> 0"), scope).select("offer_id", "row_key")


@query("lifecycle_invalidation", "OW-13", "SELECT 'grant' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 <> 0 AND c_custkey % 5 = 0")
def lifecycle_invalidation(spark: SparkSession, d: str) -> DataFrame:
    grants = _grants(spark, d).withColumn("row_key", F.col("grant_id").cast("string"))
    changes = grants.where("grant_id % 5 = 0").select("tbl", "row_key", F.lit("delete").alias("kind"), F.lit(3).cast("long").alias("tx"))
    after, _ = own.invalidate(grants, _offers(spark, d), changes)
    return after.where("revoked_tx = 3 AND grant_id % 9 <> 0").agg(F.count("*").alias("n")).select(F.lit("grant").alias("kind"), "n")


@query("principal_ids", "OW-14 SRC-03", """
WITH known AS (SELECT user_id AS key, row_number() OVER (ORDER BY user_id) AS id FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 = 0)),
fresh AS (SELECT user_id AS key, min(event_id) AS first FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)
SELECT key, id FROM known UNION ALL SELECT key, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first, key) FROM fresh""")
def principal_ids(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.operators.writes import with_row_ids

    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"))
    known = with_row_ids(e.where("key % 4 = 0").select("key").distinct(), ["key"], 0, "id")
    return own.principal_ids(known, e)


@query("policy_versions", "OW-15", "SELECT n_nationkey AS policy, CASE WHEN n_nationkey % 3 = 0 THEN 4 WHEN n_nationkey % 3 = 1 THEN 3 ELSE 2 END AS version FROM nation")
def policy_versions(spark: SparkSession, d: str) -> DataFrame:
    policies = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("policy"), F.lit(2).alias("version"))
    ask = lambda *pairs: F.array(*(F.struct(F.lit(e).alias("expected"), F.lit(t).alias("tx")) for e, t in pairs))
    asks = F.when(F.col("policy") % 3 == 0, ask((2, 1), (3, 2), (3, 3))).when(F.col("policy") % 3 == 1, ask((2, 1), (4, 2), (2, 3))).otherwise(ask((1, 1), (9, 2), (7, 3)))
    changes = policies.select("policy", F.explode(asks).alias("a")).select("policy", F.col("a.expected").alias("expected"), F.col("a.tx").alias("tx"))
    return own.policy_updates(policies, changes)


@query("sealed_puts", "OW-16", "SELECT c_custkey AS put_id, CASE WHEN c_custkey % 4 = 0 THEN 'platform:stale_policy' WHEN c_custkey % 4 = 1 THEN 'platform:recipients' WHEN c_custkey % 4 = 2 THEN 'platform:repeated_recipient' ELSE 'accepted' END AS outcome FROM customer")
def sealed_puts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    policies = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("policy"), F.lit(2).alias("version"), F.array(F.lit("a"), F.lit("b")).alias("readers"))
    recipients = F.when(k % 4 == 1, F.array(F.lit("a"))).when(k % 4 == 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    puts = read_table(spark, d, "customer").select(k.alias("put_id"), F.col("c_nationkey").alias("policy"), F.when(k % 4 == 0, 1).otherwise(2).alias("policy_version"), recipients.alias("recipients"))
    return own.sealed_puts(puts, policies)


@query("registry_reconciliation", "OW-17", "SELECT * FROM (VALUES ('b', 'schema_unregistered'), ('c', 'no_primary_key'), ('d', 'missing_table')) AS t(tbl, problem)")
def registry_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "tbl string, has_key boolean")
    return own.reconcile(catalog, spark.createDataFrame([("a",), ("c",), ("d",)], "tbl string"))


@query("seeding_window", "OW-19", "SELECT event_id AS idx, event_id <= (SELECT min(event_id) FROM events WHERE event_type = 'signup') AS open FROM events")
def seeding_window(spark: SparkSession, d: str) -> DataFrame:
    """Which transactions may seed, if the first signup closes the window."""
    e = read_table(spark, d, "events").select(F.col("event_id").alias("idx"), F.when(F.col("event_type") == "signup", "close-seeding").otherwise(F.col("event_type")).alias("operation"), F.lit("accepted").alias("outcome"))
    return own.seeding_window(e)
