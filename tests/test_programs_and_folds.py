"""SQL programs against a plain database, folds and digests over any partitioning, searches against brute force, event segments, streams."""

import hashlib
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.ledger import ownership, sql_programs
from ledgerloom.operators import folds, search
from ledgerloom.sources.event_store import BrokenHistory, EventStore
from ledgerloom.sources.snapshots import SnapshotStore, shared_folder
from ledgerloom.streaming import live

SCHEMA = (
    "CREATE TABLE stock(item TEXT PRIMARY KEY, n INTEGER NOT NULL CHECK (n >= 0))", "CREATE TABLE sold(item TEXT, n INTEGER)",
    "CREATE TRIGGER s AFTER UPDATE OF n ON stock WHEN new.n < old.n BEGIN INSERT INTO sold VALUES (old.item, old.n - new.n); END",
)


def programs(seed, n=80):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        item, k = r.choice("abc"), r.randint(1, 9)
        texts = [("INSERT INTO stock VALUES (?1, ?2) ON CONFLICT(item) DO UPDATE SET n = n + excluded.n", f'["{item}", {k}]')] if r.random() < 0.5 else [("UPDATE stock SET n = n - ?2 WHERE item = ?1", f'["{item}", {k}]')]
        if r.random() < 0.2:
            texts.append(("DELETE FROM stock WHERE item = ?1 AND n = 0", f'["{item}"]'))
        rows.append((i, 1000 + i, f"g{r.randrange(3)}", "someone", i, [(t, p, None, None) for t, p in texts] + [(None, None, "done", str(i))]))
    return rows


def plain(rows):
    held, out = {}, []
    for idx, _, grp, _, _, steps in rows:
        if grp not in held:
            held[grp] = sqlite3.connect(":memory:", isolation_level=None)
            for s in SCHEMA:
                held[grp].execute(s)
        con = held[grp]
        con.execute("BEGIN")
        try:
            for text, params, _, _ in steps:
                if text:
                    con.execute(text, __import__("json").loads(params))
            con.execute("COMMIT")
            out.append((idx, "accepted"))
        except sqlite3.IntegrityError:
            con.execute("ROLLBACK")
            out.append((idx, "rejected"))
    state = sorted((g, t, row) for g, con in held.items() for t in ("stock", "sold") for row in con.execute(f"SELECT item, n FROM {t}"))
    return out, state


@pytest.mark.parametrize("seed", [3, 17])
def test_sql_programs_equal_a_plain_database(spark, seed):
    rows = programs(seed)
    given = spark.createDataFrame(rows, sql_programs.PROGRAMS).repartition(3)
    wanted, held = plain(rows)
    value = lambda r: (__import__("json").loads(r.row)["item"], __import__("json").loads(r.row)["n"])
    outcomes, state, events = sql_programs.replay(given, SCHEMA, ("stock", "sold"))
    assert sorted((r.idx, r.outcome) for r in outcomes.collect()) == wanted and any(o == "rejected" for _, o in wanted)
    assert sorted((r.grp, r.tbl, value(r)) for r in state.collect()) == held
    assert sorted(int(r.payload) for r in events.collect()) == [i for i, o in wanted if o == "accepted"]
    first = sql_programs.replay(given.where("idx <= 40"), SCHEMA, ("stock", "sold"))[1]
    resumed = sql_programs.replay(given.where("idx > 40"), SCHEMA, ("stock", "sold"), state=first)[1]
    assert sorted((r.grp, r.tbl, value(r)) for r in resumed.collect()) == held


def test_programs_stay_within_their_bounds(spark):
    def one(*texts, tx=1):
        return (tx, tx, f"g{tx}", "a", 0, [(t, None, None, None) for t in texts])

    cases = {
        "too_large": one(*["SELECT 1"] * 300, tx=1), "denied": one("CREATE TEMP TABLE x(a)", tx=2), "step_limit": one("WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) SELECT max(x) FROM r", tx=3),
        "constraint": one("INSERT INTO stock VALUES ('a', -1)", tx=4), None: one("CREATE TABLE more(x)", "INSERT INTO more VALUES (1)", tx=5),
    }
    got = {r.idx: r.rejection_code for r in sql_programs.replay(spark.createDataFrame(list(cases.values()), sql_programs.PROGRAMS), SCHEMA, ("stock",), budget=50_000)[0].collect()}
    assert got == {row[0]: code for code, row in cases.items()}
    assert sql_programs.replay(spark.createDataFrame([], sql_programs.PROGRAMS), SCHEMA, ("stock",))[0].count() == 0


def test_a_group_is_folded_in_order_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("at"), F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("line")).repartition(5)
        got = {r.g: r.digest for r in folds.line_digests(rows, "g", [F.col("at")], F.col("line")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: hashlib.sha256("\n".join(str(i) for i in range(g, 500, 3) if i % 10).encode()).hexdigest() for g in range(3)}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_of_each_by_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 64)
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (300, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [1.0]), (302, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = table.where("vec_id % 50 = 0 AND vec_id < 300 AND aggregate(embedding, 0D, (a, x) -> a + x * x) > 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.nearest_of_each(queries, table, 6, metric=metric).collect()}
    for qid in {k for k, _ in got}:
        q, every = v[qid], [(i, x) for i, x in [*enumerate(v), (302, np.zeros(4))] if metric == "l2" or x @ x > 0]
        far = (lambda x: np.sqrt(((q - x) ** 2).sum())) if metric == "l2" else (lambda x: ((q / np.sqrt(q @ q) - x / np.sqrt(x @ x)) ** 2).sum() / 2)
        wanted = sorted((round(float(far(x)), 9), i) for i, x in every)[:6]
        assert [round(got[qid, r][1], 9) for r in range(1, 7)] == [d for d, _ in wanted]
    with pytest.raises(ValueError):
        search.nearest_of_each(queries, table, 6, most_bytes=10)


def test_event_segments_are_linked(spark):
    store = EventStore(spark)
    rows = spark.range(1, 31).select(F.col("id").alias("idx"), F.lit("x").alias("payload"))
    for lo in (0, 10, 20):
        store.append(rows.where(f"idx > {lo} AND idx <= {lo + 10}"))
    assert sorted(r.idx for r in store.load().collect()) == list(range(1, 31))
    with pytest.raises(BrokenHistory):
        store.append(rows.where("idx = 30"))
    rows.where("idx > 10 AND idx <= 20").withColumn("payload", F.lit("y")).write.mode("overwrite").parquet(f"{store.folder}/segments/segment=000000001")
    with pytest.raises(BrokenHistory):
        store.load().count()
    with pytest.raises(BrokenHistory):
        EventStore(spark).load()


def test_live_answers_change_with_their_input(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + (10 if i != 1 else 0)).write.mode("append").parquet(f"{tmp_path}/t")
    counts = live.LiveQuery(spark, lambda rows: rows.agg(F.count("*").alias("n")), SnapshotStore(spark))
    stream = live.file_stream(spark, f"{tmp_path}/t", files_per_batch=1)
    assert counts.follow(stream).head().n == 20 and len(counts.changes) >= 2
    spark.range(100, 105).write.mode("append").parquet(f"{tmp_path}/t")
    assert counts.follow(live.file_stream(spark, f"{tmp_path}/t", files_per_batch=1)).head().n == 25


def test_a_replace_needs_both_rights(spark):
    owners = spark.createDataFrame([("a", "a", o) for o in ("insert", "update", "delete")], "actor string, owner string, op string")
    none = spark.createDataFrame([], "grant_id long, tbl string, grantor string, grantee string, row_key string, op_insert boolean, op_update boolean, op_delete boolean, columns array<string>, created_tx long, revoked_tx long")
    writes = spark.createDataFrame([(1, "a", "a", "k1", "a"), (2, "a", "a", "k2", "b"), (3, "a", "b", "k3", "a"), (4, "a", "a", "k4", None)], "tx_id long, actor string, owner string, row_key string, old_owner string").withColumn("changed", F.array().cast("array<string>"))
    assert {r.tx_id: r.allowed for r in ownership.check_replaces(writes, owners, none, "t").collect()} == {1: True, 2: False, 3: False, 4: True}


def test_no_side_of_the_write_checks_is_broadcast(spark):
    """What explodes is estimated at the size of its files, so an estimate lets far too many rows through the driver."""
    actors = spark.range(50).selectExpr("CAST(id AS STRING) AS actor")
    members = actors.selectExpr("'c' AS collective", "actor AS member", "'admin' AS role", "'active' AS state", "1 AS joined_tx", "CAST(NULL AS BIGINT) AS left_tx")
    rights = spark.createDataFrame([("c", "member", "admin", "admin")], "collective string, insert_role string, update_role string, delete_role string")
    owners = ownership.actor_owners(actors, members, rights)
    grants = actors.selectExpr("CAST(actor AS BIGINT) AS grant_id", "'t' AS tbl", "actor AS grantor", "'7' AS grantee", "IF(actor % 2 = 0, 'k5', NULL) AS row_key", "true AS op_insert", "false AS op_update", "actor < 20 AS op_delete", "CAST(NULL AS ARRAY<STRING>) AS columns", "1L AS created_tx", "CAST(NULL AS BIGINT) AS revoked_tx")
    writes = actors.selectExpr("CAST(actor AS BIGINT) AS tx_id", "IF(actor < 30, '7', actor) AS actor", "actor AS owner", "concat('k', actor % 10) AS row_key", "IF(actor % 3 = 0, 'c', actor) AS old_owner", "CAST(array() AS ARRAY<STRING>) AS changed")
    got = ownership.check_replaces(writes, owners, grants, "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1, plan  # the collectives' rights

    def granted(i, op):
        return (i % 2 == 1 or i % 10 == 5) and (op == "insert" or i < 20)

    want = {i: (i >= 30 or i == 7 or granted(i, "insert")) and (i % 3 == 0 or i >= 30 or i == 7 or granted(i, "delete")) for i in range(50)}
    assert {r.tx_id: r.allowed for r in got.collect()} == want


def test_a_cluster_needs_a_named_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
    with pytest.raises(ValueError):
        shared_folder(Session())
    Session.sparkContext.master = "local[4]"
    Context.master = "local[4]"
    assert shared_folder(Session())
