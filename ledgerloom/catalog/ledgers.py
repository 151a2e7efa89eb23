"""Ledgers: order, validation, replay with rejections, late arrivals, checkpoints, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.catalog._registry import Registry
from ledgerloom.functions import values
from ledgerloom.ledger import history, replay, sql_programs
from ledgerloom.operators.folds import line_digests
from ledgerloom.sources.snapshots import SnapshotStore, checkpointed
from ledgerloom.sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

_LEDGER = """SELECT event_id AS tx_id, user_id AS author, event_type || ':' || strftime(ts, '%Y-%m-%d') AS operation, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, event_type, props,
CASE WHEN event_type = 'purchase' THEN -CAST(round(value * 100) AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) // 4 END AS amount FROM events"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return history.from_events(read_table(spark, d, "events"))


def programs(spark: SparkSession, d: str) -> DataFrame:
    """The events' ledger as programs on one balance for each author: a debit asserts the balance first."""
    step = lambda op, value, code: F.struct(F.lit(op).alias("op"), F.col("author").cast("string").alias("key"), value.alias("value"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("payload"))
    add = step("add", F.col("amount"), None)
    emit = F.struct(F.lit("emit").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("string").alias("code"), F.col("event_type").alias("topic"), F.col("props").alias("payload"))
    steps = F.when(F.col("amount") < 0, F.array(step("assert_at_least", -F.col("amount"), "balance"), add, emit)).otherwise(F.array(add, emit))
    out = ledger(spark, d).withColumn("steps", steps.cast(f"array<{replay.STEP}>"))
    return history.with_index(out.withColumn("operation", F.concat_ws(":", "operation", F.col("tx_id")))).select(*(c.split()[0] for c in replay.LEDGER.split(", ")[:5]), "steps")


def _replayed(source: str) -> str:
    """A recursive statement that folds each author's amounts in order."""
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts_ms, tx_id) AS n FROM ({source})),
f AS (SELECT author, n, tx_id, amount, amount >= 0 AS ok, CASE WHEN amount >= 0 THEN amount ELSE CAST(0 AS BIGINT) END AS balance FROM s WHERE n = 1
 UNION ALL SELECT s.author, s.n, s.tx_id, s.amount, f.balance + s.amount >= 0, CASE WHEN f.balance + s.amount >= 0 THEN f.balance + s.amount ELSE f.balance END FROM f JOIN s ON s.author = f.author AND s.n = f.n + 1)"""


@query("ledger_order", "ST-07 SRC-02 SRC-16 LG-17", f"SELECT tx_id, author, row_number() OVER (ORDER BY ts_ms, author, tx_id) AS idx FROM ({_LEDGER})")
def ledger_order(spark: SparkSession, d: str) -> DataFrame:
    return history.with_index(ledger(spark, d)).select("tx_id", "author", "idx")


@query("ledger_opconflict", "LG-05", f"SELECT tx_id, row_number() OVER (PARTITION BY author, operation ORDER BY ts_ms, author, tx_id) > 1 AS conflict FROM ({_LEDGER})")
def ledger_opconflict(spark: SparkSession, d: str) -> DataFrame:
    return history.operation_conflicts(ledger(spark, d)).select("tx_id", "conflict")


@query("ledger_replay_balance", "LG-01 LG-02 LG-03 LG-04", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT tx_id, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN NOT ok THEN 'assert:balance' END AS rejection_code, CASE WHEN NOT ok THEN 0 END AS failing_step FROM f")
def ledger_replay_balance(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(programs(spark, d))[0].select("tx_id", "outcome", "rejection_code", "failing_step")


@query("ledger_replay_state", "LG-02 LG-21 LG-22", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT CAST(author AS VARCHAR) AS key, arg_max(balance, n) AS value FROM f GROUP BY author HAVING bool_or(ok)")
def ledger_replay_state(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(programs(spark, d))[1]


_EARLY = f"SELECT * FROM ({_LEDGER}) WHERE tx_id % 10 <> 0"


@query("ledger_replay_late", "LG-06 LG-07 LG-11 SM-10 SO-08", f"""WITH RECURSIVE {_replayed(_EARLY)}, {_replayed(_LEDGER).replace('s AS', 's2 AS', 1).replace('f AS', 'f2 AS', 1).replace('FROM s WHERE', 'FROM s2 WHERE').replace('FROM f JOIN s ON s.author = f.author AND s.n = f.n + 1', 'FROM f2 JOIN s2 ON s2.author = f2.author AND s2.n = f2.n + 1').replace('SELECT s.author, s.n, s.tx_id, s.amount, f.balance + s.amount >= 0, CASE WHEN f.balance + s.amount >= 0 THEN f.balance + s.amount ELSE f.balance END', 'SELECT s2.author, s2.n, s2.tx_id, s2.amount, f2.balance + s2.amount >= 0, CASE WHEN f2.balance + s2.amount >= 0 THEN f2.balance + s2.amount ELSE f2.balance END')}
SELECT f2.tx_id, CASE WHEN f.tx_id IS NOT NULL THEN CASE WHEN f.ok THEN 'accepted' ELSE 'rejected' END END AS "before", CASE WHEN f2.ok THEN 'accepted' ELSE 'rejected' END AS "after"
FROM f2 LEFT JOIN f ON f.tx_id = f2.tx_id WHERE f.ok IS DISTINCT FROM f2.ok""")
def ledger_replay_late(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes that change when every tenth transaction arrives late: the suffix from the last checkpoint before it is replayed."""
    whole = programs(spark, d)
    m = replay.Materializer(spark, SnapshotStore(spark))
    early = history.with_index(whole.drop("idx").where("tx_id % 10 <> 0")).select(*whole.columns)
    first = m.materialize(early)
    before = m.local_log(first.number).select("tx_id", "outcome")
    m.store.capture(first.number)  # the result still reads it
    m.materialize(whole)
    return history.outcome_changes(before, m.local_log())


@query("ledger_outcome_diff", "LG-11 SO-08", f"SELECT tx_id, CASE WHEN tx_id % 7 = 0 THEN NULL ELSE 'accepted' END AS \"before\", CASE WHEN tx_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS \"after\" FROM ({_LEDGER}) WHERE tx_id % 7 = 0 OR tx_id % 5 = 0")
def ledger_outcome_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).select("tx_id")
    before = rows.where("tx_id % 7 <> 0").withColumn("outcome", F.lit("accepted"))
    return history.outcome_changes(before, rows.withColumn("outcome", F.when(F.col("tx_id") % 5 == 0, "rejected").otherwise("accepted")))


@query("ledger_earliest_diff", "SO-09 LG-06", f"WITH o AS (SELECT tx_id, row_number() OVER (ORDER BY ts_ms, author, tx_id) AS idx FROM ({_LEDGER})), e AS (SELECT tx_id, row_number() OVER (ORDER BY ts_ms, author, tx_id) AS idx FROM ({_EARLY})) SELECT min(coalesce(o.idx, e.idx)) AS idx FROM o FULL OUTER JOIN e ON o.idx = e.idx WHERE o.tx_id IS DISTINCT FROM e.tx_id")
def ledger_earliest_diff(spark: SparkSession, d: str) -> DataFrame:
    whole = ledger(spark, d)
    return history.earliest_difference(history.with_index(whole), history.with_index(whole.where("tx_id % 10 <> 0")))


@query("ledger_validation", "LG-15 LG-16", f"SELECT 'duplicate_id' AS problem, count(*) AS n FROM ({_LEDGER}) WHERE tx_id % 50 = 0 UNION ALL SELECT 'incomplete', count(*) FROM ({_LEDGER}) WHERE tx_id % 20 = 3")
def ledger_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d)
    broken = rows.withColumn("author", F.when(F.col("tx_id") % 20 != 3, F.col("author"))).unionByName(rows.where("tx_id % 50 = 0"))
    return history.invalid_inputs(broken)


@query("ledger_identity_conflict", "LG-16", f"SELECT tx_id FROM ({_LEDGER}) WHERE tx_id % 40 = 0")
def ledger_identity_conflict(spark: SparkSession, d: str) -> DataFrame:
    known = ledger(spark, d).withColumn("digest", F.sha2(F.concat_ws("|", "tx_id", "amount"), 256))
    given = known.withColumn("digest", F.when(F.col("tx_id") % 40 == 0, F.lit("other")).otherwise(F.col("digest")))
    return history.identity_conflicts(known, given).select("tx_id")


@query("ledger_contiguity", "LG-17", f"SELECT count(*) AS n, count(*) AS top, true AS contiguous FROM ({_LEDGER})")
def ledger_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return history.contiguity(history.with_index(ledger(spark, d)))


@query("ledger_checkpoint_plan", "LG-08 LG-09", f"WITH c AS (SELECT count(*) AS n FROM ({_LEDGER})) SELECT 0 AS prefix UNION ALL SELECT p FROM (SELECT unnest(generate_series(500, n, 500)) AS p FROM c ORDER BY 1 DESC LIMIT 16)")
def ledger_checkpoint_plan(spark: SparkSession, d: str) -> DataFrame:
    kept = history.checkpoint_plan(ledger(spark, d).count(), every=500, keep=16)
    return spark.createDataFrame([(k,) for k in kept], "prefix long")


def _published(spark: SparkSession, d: str) -> tuple[replay.Materializer, DataFrame, int, str]:
    """A materializer that has published half of the ledger, under a lease, and then all of it: (it, the ledger, its length, the lease)."""
    whole = checkpointed(programs(spark, d))
    n = whole.count()
    m = replay.Materializer(spark, SnapshotStore(spark), every=max(1, n // 10))
    m.materialize(whole.where(F.col("idx") <= n // 2))
    lease = m.store.capture()
    m.materialize(whole)
    return m, whole, n, lease


_LOG = f"WITH RECURSIVE {_replayed(_LEDGER)}, log AS (SELECT l.tx_id, f.ok, row_number() OVER (ORDER BY l.ts_ms, l.author, l.tx_id) AS idx, count(*) OVER () AS n FROM ({_LEDGER}) l JOIN f ON f.tx_id = l.tx_id)"
_OUTCOME = "CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome"


@query("ledger_final_prefix", "LG-10 SM-11", f"{_LOG} SELECT idx, tx_id, {_OUTCOME} FROM log WHERE idx <= n // 4")
def ledger_final_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The final quarter of the log: it stays as it is when a change of it is tried, and when a shorter prefix is declared final."""
    m, whole, n, _ = _published(spark, d)
    m.finalize(n // 4)
    without = history.with_index(whole.where(F.col("idx") != n // 8).drop("idx")).select(*whole.columns)
    for refused, work in ((replay.ProtectedPrefix, lambda: m.materialize(without)), (ValueError, lambda: m.finalize(n // 8)), (replay.ManifestUnavailable, lambda: m.materialize(whole, manifest="unknown"))):
        try:
            work()
        except refused:
            continue
        raise AssertionError("a change of the final prefix was taken")
    return m.final_log().select("idx", "tx_id", "outcome")


@query("ledger_leased_revision", "LG-12 LG-13 LG-14 SRC-15", f"{_LOG} SELECT idx, tx_id, {_OUTCOME} FROM log WHERE idx <= n // 2")
def ledger_leased_revision(spark: SparkSession, d: str) -> DataFrame:
    """The older revision as its lease reads it, after a newer one was published and old ones were dropped."""
    m, _, _, lease = _published(spark, d)
    m.store.retain(1)
    return m.store.leased(lease, "log").select("idx", "tx_id", "outcome")


@query("ledger_checkpoints_kept", "LG-08 LG-09", f"{_LOG} SELECT p.prefix, (SELECT count(*) FROM log WHERE idx <= p.prefix AND ok) AS accepted FROM (SELECT 0 AS prefix UNION ALL SELECT 3 * (count(*) // 4) FROM events UNION ALL SELECT count(*) FROM events) p")
def ledger_checkpoints_kept(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints after four appends, of which the empty one and the newest two stay, each with what its revision says."""
    whole = checkpointed(programs(spark, d))
    n = whole.count()
    m = replay.Materializer(spark, SnapshotStore(spark), every=max(1, n // 4), keep=2)
    for length in (n // 4, 2 * (n // 4), 3 * (n // 4), n):
        m.materialize(whole.where(F.col("idx") <= length))
    rows = [(prefix, m.local_log(revision).where("outcome = 'accepted'").count()) for prefix, revision in m.checkpoints.items()]
    return spark.createDataFrame(rows, "prefix long, accepted long")


@query("ledger_blocked", "LG-19 LG-20", "SELECT true AS blocked, true AS unavailable, true AS unchanged")
def ledger_blocked(spark: SparkSession, d: str) -> DataFrame:
    """An unknown manifest and a lost revision stop the work and reject nothing."""
    m, whole, _, _ = _published(spark, d)
    before, found = m.head, []
    for refused, work in ((replay.ManifestUnavailable, lambda: m.materialize(whole, manifest="unknown")), (LookupError, lambda: m.store.read("log", 999))):
        try:
            work()
            found.append(False)
        except refused:
            found.append(True)
    return spark.createDataFrame([(*found, m.head == before)], "blocked boolean, unavailable boolean, unchanged boolean")


@query("ledger_emit_only", "LG-18", f"SELECT tx_id, 'rejected' AS outcome, 'profile:sql-disabled' AS rejection_code FROM ({_LEDGER})")
def ledger_emit_only(spark: SparkSession, d: str) -> DataFrame:
    return replay.without_sql(programs(spark, d)).select("tx_id", "outcome", "rejection_code")


@query("ledger_content_hash", "LG-21", "SELECT true AS equal")
def ledger_content_hash(spark: SparkSession, d: str) -> DataFrame:
    state = replay.replay(programs(spark, d))[1]
    h = lambda df: df.agg(values.content_hash([F.col("key"), F.col("value")]).alias("h"))
    return h(state).join(h(state.repartition(3).orderBy("value")).withColumnRenamed("h", "g"), F.lit(True)).select((F.col("h") == F.col("g")).alias("equal"))


_CHAIN = f"SELECT author % 4 AS generation, row_number() OVER (PARTITION BY author % 4 ORDER BY ts_ms, tx_id) AS seq, tx_id FROM ({_LEDGER})"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("generation").orderBy("ts_ms", "tx_id")
    rows = ledger(spark, d).withColumn("generation", F.col("author") % 4)
    rows = rows.withColumn("seq", F.row_number().over(w)).withColumn("root", F.sha2(F.col("tx_id").cast("string"), 256))
    return rows.withColumn("previous_root", F.lag("root").over(w))


@query("ledger_chain_check", "LG-25 SRC-16", f"SELECT generation, seq FROM ({_CHAIN}) WHERE seq % 100 = 51")
def ledger_chain_check(spark: SparkSession, d: str) -> DataFrame:
    broken = _chain(spark, d).withColumn("previous_root", F.when(F.col("seq") % 100 == 51, F.lit("x")).otherwise(F.col("previous_root")))
    return history.chain_breaks(broken)


@query("ledger_equivocation", "LG-26", f"SELECT generation, seq, 2 AS roots FROM ({_CHAIN}) WHERE tx_id % 30 = 0")
def ledger_equivocation(spark: SparkSession, d: str) -> DataFrame:
    chain = _chain(spark, d)
    return history.equivocations(chain.unionByName(chain.where("tx_id % 30 = 0").withColumn("root", F.lit("other"))))


@query("ledger_selected_history", "LG-24 JN-13", f"SELECT tx_id, segment FROM ({_CHAIN}) c JOIN (VALUES (0, 0, 300), (1, 2, 500), (2, 3, NULL)) AS s(segment, generation, cutoff) ON c.generation = s.generation WHERE cutoff IS NULL OR seq <= cutoff")
def ledger_selected_history(spark: SparkSession, d: str) -> DataFrame:
    segments = spark.createDataFrame([(0, 0, 300), (1, 2, 500), (2, 3, None)], "segment int, generation long, cutoff int")
    return history.selected_history(_chain(spark, d), segments).select("tx_id", "segment")


@query("ledger_digest", "AG-16", "SELECT event_type, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY event_type")
def ledger_digest(spark: SparkSession, d: str) -> DataFrame:
    return line_digests(read_table(spark, d, "events"), "event_type", [F.col("event_id")], F.col("event_id").cast("string"))


@query("op_state", "LG-27", "SELECT event_id AS tx_id, CASE WHEN event_id % 11 = 0 THEN 'abandoned' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'applied' WHEN event_id % 3 = 0 THEN 'needs_reapply' ELSE 'saved' END AS state FROM events")
def op_state(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("event_id").alias("tx_id"))
    return history.operation_states(e, e.where("tx_id % 3 = 0"), e.where("tx_id % 11 = 0"), e.where("tx_id % 2 = 0"))


@query("coverage_latest", "LG-28", "SELECT user_id AS peer, arg_max(event_id % 1000, event_id) AS point FROM events GROUP BY user_id HAVING arg_max(event_id % 1000, event_id) >= 500")
def coverage_latest(spark: SparkSession, d: str) -> DataFrame:
    reports = read_table(spark, d, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).alias("point"))
    return history.coverage(reports, 500)


@query("membership_asof", "LG-23 FN-03", "SELECT e.event_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'signup' AND c.event_id <= e.event_id) AS control FROM events e WHERE e.event_type <> 'signup'")
def membership_asof(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type")
    controls = e.where("event_type = 'signup'").withColumn("control", F.col("event_id"))
    return history.as_of(e.where("event_type <> 'signup'"), controls, "user_id", "event_id").select("event_id", F.col("control").cast("long").alias("control"))


@query("command_export", "SRC-18", f"WITH o AS (SELECT tx_id, row_number() OVER (ORDER BY ts_ms, author, tx_id) AS idx FROM ({_LEDGER})) SELECT tx_id, idx FROM (SELECT *, sum(50) OVER (ORDER BY idx) AS total FROM o WHERE idx > 100 AND idx <= 200) WHERE total <= 2525")
def command_export(spark: SparkSession, d: str) -> DataFrame:
    rows = history.with_index(ledger(spark, d)).withColumn("bytes", F.lit(50))
    return history.export_range(rows, after=100, limit=100, max_bytes=2525).select("tx_id", "idx")


# SQL programs.


def _sql_ledger(spark: SparkSession, d: str, steps: Column) -> DataFrame:
    """The events' ledger with SQL steps, dealt by author."""
    out = history.with_index(ledger(spark, d))
    return out.select("idx", "tx_id", F.col("author").cast("string").alias("grp"), F.col("author").cast("string").alias("author"), "ts_ms", "event_type", "amount", steps.cast(f"array<{sql_programs.STEP}>").alias("steps"))


def _statement(text: str, *values: Column) -> Column:
    params = F.concat(F.lit("["), F.concat_ws(",", *(v.cast("string") for v in values)), F.lit("]")) if values else F.lit(None).cast("string")
    return F.struct(F.lit(text).alias("sql"), params.alias("params"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("payload"))


def _emit(topic: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("sql"), F.lit(None).cast("string").alias("params"), topic.alias("topic"), F.lit("{}").alias("payload"))


_ACCOUNTS = (
    "CREATE TABLE account(k INTEGER PRIMARY KEY, balance INTEGER NOT NULL CHECK (balance >= 0))", "CREATE TABLE audit(tx INTEGER PRIMARY KEY, was INTEGER, now INTEGER)",
    "CREATE TRIGGER spent AFTER UPDATE OF balance ON account WHEN new.balance < old.balance BEGIN INSERT INTO audit VALUES (transaction_id(), old.balance, new.balance); END",
)


def _account_programs(spark: SparkSession, d: str) -> DataFrame:
    """A credit is an upsert; a debit asserts the balance and lowers it."""
    credit = _statement("INSERT INTO account(k, balance) VALUES (1, ?1) ON CONFLICT(k) DO UPDATE SET balance = balance + excluded.balance", F.col("amount"))
    check = _statement("SELECT assert_that(coalesce((SELECT balance FROM account WHERE k = 1), -1) >= ?1, 'balance')", -F.col("amount"))
    debit = _statement("UPDATE account SET balance = balance - ?1 WHERE k = 1", -F.col("amount"))
    return _sql_ledger(spark, d, F.when(F.col("amount") < 0, F.array(check, debit, _emit(F.col("event_type")))).otherwise(F.array(credit, _emit(F.col("event_type")))))


def _accounts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return sql_programs.replay(_account_programs(spark, d), _ACCOUNTS, ("account", "audit"))


@query("sql_replay_outcomes", "LG-01 LG-02 LG-03 LG-04 FN-01 FN-CNT SNK-05", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT tx_id, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN NOT ok THEN 'assert:balance' END AS rejection_code, CASE WHEN NOT ok THEN 0 END AS failing_step, CASE WHEN NOT ok THEN 0 WHEN amount < 0 THEN 2 ELSE 1 END AS changes FROM f")
def sql_replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Changed rows count the trigger's."""
    return _accounts(spark, d)[0].select("tx_id", "outcome", "rejection_code", "failing_step", "changes")


@query("sql_replay_audit", "UF-05 LG-02 FN-07", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT tx_id, balance - amount AS was, balance AS \"now\" FROM f WHERE ok AND amount < 0")
def sql_replay_audit(spark: SparkSession, d: str) -> DataFrame:
    """What an AFTER UPDATE OF ... WHEN trigger wrote, for accepted programs only."""
    row = F.from_json("row", "tx long, was long, now long")
    return _accounts(spark, d)[1].where("tbl = 'audit'").select(row.alias("r")).select(F.col("r.tx").alias("tx_id"), "r.was", "r.now")


@query("sql_replay_events", "SM-01 LG-02", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT e.event_type AS topic, count(*) AS n FROM f JOIN events e ON e.event_id = f.tx_id WHERE ok GROUP BY 1")
def sql_replay_events(spark: SparkSession, d: str) -> DataFrame:
    return _accounts(spark, d)[2].groupBy("topic").agg(F.count("*").alias("n"))


@query("sql_replay_resumed", "LG-06 LG-08 LG-14", f"WITH RECURSIVE {_replayed(_LEDGER)} SELECT CAST(author AS VARCHAR) AS grp, arg_max(balance, n) AS balance FROM f GROUP BY author HAVING bool_or(ok)")
def sql_replay_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half of the ledger, its stored state, and the other half over it, without the stored rows firing triggers."""
    programs_ = checkpointed(_account_programs(spark, d))
    half = programs_.count() // 2
    state = sql_programs.replay(programs_.where(F.col("idx") <= half), _ACCOUNTS, ("account", "audit"))[1]
    after = sql_programs.replay(programs_.where(F.col("idx") > half), _ACCOUNTS, ("account", "audit"), state=state)[1]
    return after.where("tbl = 'account'").select("grp", F.from_json("row", "balance long")["balance"].alias("balance"))


@query("sql_replay_cascade", "UF-05 SNK-03 SNK-06", f"SELECT tx_id FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'signup' THEN n END) OVER (PARTITION BY author), 0) AS last FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts_ms, tx_id) AS n FROM ({_LEDGER}))) WHERE n >= last")
def sql_replay_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A signup deletes the parent, and its children go by the foreign key's cascade; every program then adds a child."""
    schema = ("CREATE TABLE parent(k INTEGER PRIMARY KEY)", "CREATE TABLE child(tx INTEGER PRIMARY KEY, parent INTEGER NOT NULL REFERENCES parent(k) ON DELETE CASCADE)")
    add = (_statement("INSERT OR IGNORE INTO parent VALUES (1)"), _statement("INSERT INTO child VALUES (transaction_id(), 1)"))
    steps = F.when(F.col("event_type") == "signup", F.array(_statement("DELETE FROM parent WHERE k = 1"), *add)).otherwise(F.array(*add))
    state = sql_programs.replay(_sql_ledger(spark, d, steps), schema, ("child",))[1]
    return state.select(F.from_json("row", "tx long")["tx"].alias("tx_id"))


@query("sql_replay_replace", "SNK-04 UF-05", f"SELECT tx_id, n < last AS gone FROM (SELECT tx_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY author) AS last FROM ({_LEDGER}) WINDOW w AS (PARTITION BY author ORDER BY ts_ms, tx_id))")
def sql_replay_replace(spark: SparkSession, d: str) -> DataFrame:
    """REPLACE fires the delete trigger of the row that it replaces."""
    schema = ("CREATE TABLE slot(k INTEGER PRIMARY KEY, tx INTEGER)", "CREATE TABLE gone(tx INTEGER)", "CREATE TRIGGER g AFTER DELETE ON slot BEGIN INSERT INTO gone VALUES (old.tx); END")
    state = sql_programs.replay(_sql_ledger(spark, d, F.array(_statement("REPLACE INTO slot VALUES (1, transaction_id())"))), schema, ("slot", "gone"))[1]
    return state.select(F.from_json("row", "tx long")["tx"].alias("tx_id"), (F.col("tbl") == "gone").alias("gone"))


@query("sql_replay_triggers", "UF-05", f"SELECT tx_id, CASE WHEN event_type = 'view' THEN 4 ELSE 1 END AS links, event_type <> 'click' AS before_ran FROM ({_LEDGER}) WHERE event_type <> 'purchase'")
def sql_replay_triggers(spark: SparkSession, d: str) -> DataFrame:
    """A recursive trigger links a view three times more, a BEFORE trigger marks all but clicks, and another one refuses purchases."""
    schema = (
        "CREATE TABLE link(tx INTEGER, depth INTEGER, kind TEXT)", "CREATE TABLE mark(tx INTEGER PRIMARY KEY)",
        "CREATE TRIGGER refuse BEFORE INSERT ON link WHEN new.kind = 'purchase' BEGIN SELECT RAISE(ABORT, 'no purchases'); END",
        "CREATE TRIGGER marked BEFORE INSERT ON link WHEN new.depth = 0 AND new.kind <> 'click' BEGIN INSERT INTO mark VALUES (new.tx); END",
        "CREATE TRIGGER deeper AFTER INSERT ON link WHEN new.kind = 'view' AND new.depth < 3 BEGIN INSERT INTO link VALUES (new.tx, new.depth + 1, new.kind); END",
    )
    insert = _statement("INSERT INTO link VALUES (transaction_id(), 0, ?1)", F.concat(F.lit('"'), "event_type", F.lit('"')))
    state = sql_programs.replay(_sql_ledger(spark, d, F.array(insert)), schema, ("link", "mark"))[1]
    rows = state.select("tbl", F.from_json("row", "tx long")["tx"].alias("tx_id"))
    return rows.groupBy("tx_id").agg(F.count(F.when(F.col("tbl") == "link", 1)).alias("links"), F.bool_or(F.col("tbl") == "mark").alias("before_ran"))


_TRIED = (
    ("INSERT INTO t VALUES (1, datetime('now'))", None), ("INSERT INTO t VALUES (NULL, 'x')", "constraint"), ("ATTACH 'x' AS y", "denied"), ("SELECT random()", "denied"), ("WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) SELECT count(*) FROM r", "step_limit"),
    ("SELECT nothing FROM t", "prepare"), ("SELECT assert_that(1 = 2, 'sum')", "assert:sum"), ("SELECT ?1", "binding"), ("COMMIT", "denied"), ("PRAGMA user_version = 3", "denied"), ("SELECT 1; SELECT 2", "prepare"), ("SELECT abs(-9223372036854775807 - 1)", "error"),
)


@query("sql_replay_rejections", "LG-20 PL-03 PL-07 PL-11 FN-08 SO-07", "SELECT event_id AS tx_id, " + "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN {'NULL' if c is None else repr(c)}" for i, (_, c) in enumerate(_TRIED)) + " END AS rejection_code FROM events")
def sql_replay_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Each transaction tries one statement; each on a group of its own."""
    steps = F.array(_statement(_TRIED[0][0]))
    for i, (text, _) in enumerate(_TRIED[1:], 1):
        steps = F.when(F.col("tx_id") % len(_TRIED) == i, F.array(_statement(text))).otherwise(steps)
    programs_ = _sql_ledger(spark, d, steps).withColumn("grp", F.concat_ws("/", "grp", F.col("tx_id") % len(_TRIED)))
    once = "CREATE TABLE t(k INTEGER NOT NULL, at TEXT NOT NULL)"
    return sql_programs.replay(programs_, (once,), ("t",), budget=20_000)[0].select("tx_id", "rejection_code")


_CONTROLLED = f"SELECT * FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN tx_id END) OVER (PARTITION BY author ORDER BY ts_ms, tx_id ROWS UNBOUNDED PRECEDING) AS control FROM ({_LEDGER}))"


@query("replay_under_controls", "LG-23", f"""WITH RECURSIVE {_replayed(f'SELECT * FROM ({_CONTROLLED}) WHERE control IS NOT NULL')}
SELECT c.tx_id, c.control, CASE WHEN c.control IS NULL THEN 'platform:not_member' WHEN NOT f.ok THEN 'assert:balance' END AS rejection_code FROM ({_CONTROLLED}) c LEFT JOIN f ON f.tx_id = c.tx_id""")
def replay_under_controls(spark: SparkSession, d: str) -> DataFrame:
    """Each program under the membership of its own place: nobody acts before the author's first signup, and a program that its control bars doesn't run."""
    programs_ = _account_programs(spark, d)
    places = programs_.select("idx", "tx_id", "author", "event_type")
    controls = places.where("event_type = 'signup'").withColumn("control", F.col("tx_id"))
    known = history.as_of(places, controls, "author", "idx").select("tx_id", F.col("control").cast("long").alias("control"))
    under = checkpointed(programs_.join(known, "tx_id").withColumn("code", F.when(F.col("control").isNull(), "platform:not_member")))
    outcomes = sql_programs.replay(under, _ACCOUNTS, ("account",))[0]
    return under.select("tx_id", "control").join(outcomes, "tx_id").select("tx_id", "control", "rejection_code")


@query("tx_context", "FN-02 FN-07 FN-08", f"SELECT tx_id, author AS actor, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') AS now FROM ({_LEDGER})")
def tx_context(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.functions import dates

    return ledger(spark, d).select("tx_id", F.col("author").alias("actor"), dates.current_timestamp_of(F.col("ts_ms")).alias("now"))
