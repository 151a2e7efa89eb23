"""Event streams, projections, live signals, and the reading policy."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import ledgers
from ledgerloom.catalog._registry import Registry
from ledgerloom.ledger import replay
from ledgerloom.plans.definitions import Schema
from ledgerloom.plans.policy import Mode, Rejected, check_statement, has_raise_ignore
from ledgerloom.plans.session import Session, capped_rows
from ledgerloom.sources.snapshots import SnapshotStore, checkpointed, remove_folder, shared_folder
from ledgerloom.sources.tables import read_table
from ledgerloom.streaming import events as ev
from ledgerloom.streaming import live
from ledgerloom.streaming import signals as sg

REGISTRY = Registry()
query = REGISTRY.query

_FOLD = f"WITH RECURSIVE {ledgers._replayed(ledgers._LEDGER)}, log AS (SELECT e.event_id AS tx_id, e.event_type AS topic, e.props AS payload, f.ok, row_number() OVER (ORDER BY epoch_us(e.ts) // 1000, e.user_id, e.event_id) AS idx FROM events e JOIN f ON f.tx_id = e.event_id)"


def _flat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events, log) of the replayed ledger."""
    p = checkpointed(ledgers.programs(spark, d))
    outcomes = replay.replay(p)[0]
    return ev.flatten(p, outcomes), p.select("idx", "tx_id")


@query("event_flatten", "SM-01", f"{_FOLD} SELECT idx, tx_id, 0 AS ordinal, topic, payload FROM log WHERE ok")
def event_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)[0]


@query("event_topic_page", "SM-02 SM-03", f"{_FOLD} SELECT idx, tx_id, topic FROM log WHERE ok AND idx > 128 AND idx <= 384 AND topic IN ('click', 'view')")
def event_topic_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page, of 256 transactions, after a first one of 128."""
    flat, log = _flat(spark, d)
    _, cursor = ev.page(flat, log, history="h", generation=1, topics=["click", "view"])
    rows, _ = ev.page(flat, log, history="h", generation=1, cursor=ev.Cursor.parse(cursor.text()), topics=["click", "view"], limit=256)
    return rows.select("idx", "tx_id", "topic")


@query("event_cursor_checks", "SM-03 SM-04", "SELECT true AS moved, true AS other_generation, true AS too_long")
def event_cursor_checks(spark: SparkSession, d: str) -> DataFrame:
    log = ledgers.programs(spark, d).select("idx", "tx_id")
    flat = log.withColumn("topic", F.lit("t"))
    cursor = ev.page(flat, log, history="h", generation=1)[1]
    found = []
    for work in (lambda: ev.page(flat, log.withColumn("tx_id", F.col("tx_id") + 1), history="h", generation=1, cursor=cursor), lambda: ev.page(flat, log, history="h", generation=2, cursor=cursor), lambda: ev.page(flat, log, history="h", generation=1, limit=2000)):
        try:
            work()
            found.append(False)
        except ValueError:
            found.append(True)
    return spark.createDataFrame([tuple(found)], "moved boolean, other_generation boolean, too_long boolean")


@query("change_notices", "SM-05 SM-09", "SELECT event_id // 100 AS batch, max(event_id) AS revision, bool_or(event_id % 250 = 0) AS recovered FROM events GROUP BY event_id // 100")
def change_notices(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("batch"), F.col("event_id").alias("revision"), F.when(F.col("event_id") % 250 == 0, "recovery").otherwise("append").alias("kind"))
    return ev.change_notices(e)


def _count(state: dict, event: dict) -> dict:
    """A reducer: number of events and sum of their k."""
    return {"n": state["n"] + 1, "k": state["k"] + json.loads(event["payload"])["k"]}


_START = {"k": 0, "n": 0}


@query("projection_counts", "SM-06 UF-04", f"{_FOLD} SELECT topic AS key, max(idx) AS cursor, '{{\"k\":' || CAST(sum(CAST(json_extract_string(payload, '$.k') AS BIGINT)) AS BIGINT) || ',\"n\":' || count(*) || '}}' AS state FROM log WHERE ok GROUP BY topic")
def projection_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.project(_flat(spark, d)[0], _count, _START)


@query("projection_resumed", "SM-06 SM-07 SM-08", f"{_FOLD} SELECT topic AS key, max(idx) AS cursor, '{{\"k\":' || CAST(sum(CAST(json_extract_string(payload, '$.k') AS BIGINT)) AS BIGINT) || ',\"n\":' || count(*) || '}}' AS state FROM log WHERE ok GROUP BY topic")
def projection_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half the events, a stored state, and then all of them again: those before the cursor don't count twice."""
    flat = checkpointed(_flat(spark, d)[0])
    half = checkpointed(ev.project(flat.where("idx <= 500"), _count, _START))
    return ev.project(flat, _count, _START, prior=half)


@query("projection_stream", "SM-06 SM-09", "SELECT event_type AS key, '{\"k\":' || CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) || ',\"n\":' || count(*) || '}' AS state FROM events GROUP BY event_type")
def projection_stream(spark: SparkSession, d: str) -> DataFrame:
    """The reducer over a file stream of the events, in a state store."""
    import uuid

    name = f"projection_{uuid.uuid4().hex[:8]}"
    stream = live.file_stream(spark, f"{d}/events.parquet").select(F.col("event_id").alias("idx"), F.lit(0).alias("ordinal"), F.col("event_id").alias("tx_id"), F.col("event_type").alias("topic"), F.col("props").alias("payload"))
    folder = f"{shared_folder(spark)}/{name}"
    ev.stream_projection(stream, _count, _START, name=name, folder=folder).awaitTermination()
    out = checkpointed(ev.latest_states(spark.read.parquet(ev.updates_of(folder))).select("key", "state"))
    remove_folder(spark, folder)
    return out


def _count_only(state: dict, event: dict) -> dict:
    return {"n": state["n"] + 1}


@query("projection_reset", "SM-07", "SELECT event_type AS key, max(event_id) AS cursor, '{\"n\":' || count(*) || '}' AS state FROM events GROUP BY event_type")
def projection_reset(spark: SparkSession, d: str) -> DataFrame:
    """A stored projection of the first events under an older definition, and all events under a newer one: the older states don't count."""
    e = read_table(spark, d, "events").select(F.col("event_id").alias("idx"), F.lit(0).alias("ordinal"), F.col("event_id").alias("tx_id"), F.col("event_type").alias("topic"), F.col("props").alias("payload"))
    old, new = ev.Definition("p", 1, ("x",)), ev.Definition("p", 2, ("x",))
    held = checkpointed(ev.project(e.where("idx <= 500"), _count, _START))
    if ev.must_reset(old, ev.Definition("p", 1, ("x",))) or not ev.must_reset(old, ev.Definition("p", 1, ("y",))):
        raise AssertionError("a projection is reset exactly if its definition differs")
    return ev.project(e, _count_only, {"n": 0}, prior=None if ev.must_reset(old, new) else held)


@query("settled_prefix", "SM-11", "SELECT event_id AS idx, event_id <= 500 AS final FROM events")
def settled_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("event_id").alias("idx"))
    return ev.settled(e, 500, e.where("idx > 900"))


# Signals: sequence by user and type, alive for 30 s, some sent twice.
_SIGNALS = "SELECT CAST(user_id AS VARCHAR) AS author, event_type AS topic, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS sequence, props AS payload, CAST(epoch_us(ts) // 1000 AS BIGINT) AS issued_ms FROM events"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = read_table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    once = e.select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("session"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).alias("sequence"), F.col("event_type").alias("topic"), F.col("props").alias("payload"), ms.alias("issued_ms"), (ms + sg.TTL_MS).alias("expires_ms"))
    return once.unionByName(once.where("sequence % 3 = 0").withColumn("issued_ms", F.col("issued_ms") + 5))


@query("signal_dedupe", "SM-12", f"SELECT author, topic, sequence, issued_ms FROM ({_SIGNALS})")
def signal_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return sg.dedupe(_signals(spark, d)).select("author", "topic", "sequence", "issued_ms")


@query("signal_dedupe_stream", "SM-12", "SELECT event_type AS topic, event_id AS sequence, count(*) AS n FROM events GROUP BY event_type, event_id")
def signal_dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream in which every third message comes twice: once each leaves it."""
    e = live.file_stream(spark, f"{d}/events.parquet")
    once = e.select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("session"), F.col("event_id").alias("sequence"), F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("ts"))
    again = once.withColumn("copy", F.explode(F.when(F.col("sequence") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    return live.stored(sg.dedupe_stream(again, ts="ts")).groupBy("topic", "sequence").agg(F.count("*").alias("n"))


@query("stream_join", "SM-19", "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND epoch_us(p.ts) <= epoch_us(v.ts) + 7200000000")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within two hours after a view of the same user, as a join of two streams."""
    e = live.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return live.stored(live.joined_within(views, bought, "user_id", "seen", "bought", 7200)).select("view_id", "purchase_id")


@query("live_query", "SM-20", "SELECT event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY event_type")
def live_query(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type that answer again after each batch of a stream, published as revisions."""
    counts = live.LiveQuery(spark, lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest")), SnapshotStore(spark))
    return counts.follow(live.file_stream(spark, f"{d}/events.parquet", files_per_batch=1))


_NOW = 1705300000000


@query("signal_ttl", "SM-13", f"SELECT author, topic, sequence FROM ({_SIGNALS}) WHERE issued_ms + 30000 > {_NOW} AND issued_ms <= {_NOW} + 5000 + 86400000")
def signal_ttl(spark: SparkSession, d: str) -> DataFrame:
    return sg.alive(sg.dedupe(_signals(spark, d)), _NOW).unionByName(sg.dedupe(_signals(spark, d)).where((F.col("issued_ms") > _NOW + sg.SKEW_MS) & (F.col("issued_ms") <= _NOW + sg.SKEW_MS + 86_400_000))).select("author", "topic", "sequence")


@query("signal_latest", "SM-14", f"SELECT author, topic, max(sequence) AS sequence, arg_max(payload, sequence) AS payload FROM ({_SIGNALS}) GROUP BY author, topic")
def signal_latest(spark: SparkSession, d: str) -> DataFrame:
    return sg.latest(_signals(spark, d)).select("author", "topic", "sequence", "payload")


@query("signal_all", "SM-15", f"SELECT author, count(*) AS pending, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, count(*) > 64 AS overflow FROM ({_SIGNALS}) GROUP BY author")
def signal_all(spark: SparkSession, d: str) -> DataFrame:
    return sg.all_pending(sg.dedupe(_signals(spark, d)), "author")


@query("signal_selectors", "SM-16", f"SELECT author, topic, sequence FROM ({_SIGNALS}) WHERE (topic = 'click' AND author = '7') OR topic = 'signup'")
def signal_selectors(spark: SparkSession, d: str) -> DataFrame:
    return sg.select(sg.dedupe(_signals(spark, d)), [{"topic": "click", "author": "7"}, {"topic": "signup"}]).select("author", "topic", "sequence")


@query("ext_event_windows", "SM-18", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n")


@query("ext_sessions", "SM-18", """SELECT user_id, n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
FROM (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)) GROUP BY user_id, s)""")
def ext_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e, 86_400, key="user_id", ts="ts").select("user_id", "n")


# The policy, as tables of outcomes.

_STATEMENTS = [
    ("SELECT 1", "ok"), ("SELECT 1;;  -- done", "ok"), ("WITH a AS (SELECT 1 AS x) SELECT x FROM a", "ok"), ("VALUES (1)", "ok"), ("EXPLAIN SELECT 1", "ok"), ("SELECT 'drop; table' AS x", "ok"),
    ("SELECT 1; SELECT 2", "prepare"), ("", "prepare"), ("-- nothing", "prepare"), ("INSERT INTO t VALUES (1)", "denied"), ("DROP TABLE t", "denied"), ("SET a = 1", "denied"), ("ATTACH 'x' AS y", "denied"),
    ("SELECT java_method('a', 'b')", "denied"), ("SELECT reflect()", "denied"), ("SELECT uuid()", "denied"), ("SELECT current_timestamp", "denied"), ("SELECT rand()", "denied"), ("PRAGMA table_info(t)", "denied"),
    ("SELECT " + "(" * 101 + "1" + ")" * 101, "too_large"), ("SELECT 1 " + "UNION SELECT 1 " * 33, "too_large"),
]


@query("policy_denied", "PL-01 PL-02 PL-03 PL-04 PL-05 PL-06 PL-09 PL-12 SRC-23", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(_STATEMENTS)) + ") AS t(n, code)")
def policy_denied(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for i, (text, _) in enumerate(_STATEMENTS):
        try:
            check_statement(text, Mode.LOCAL_READ)
            rows.append((i, "ok"))
        except Rejected as e:
            rows.append((i, e.code))
    return spark.createDataFrame(rows, "n int, code string")


@query("policy_modes", "PL-01", "SELECT * FROM (VALUES ('bootstrap', true, false), ('consensus', true, false), ('platform', true, false), ('local_read', false, false)) AS t(mode, writes, attach)")
def policy_modes(spark: SparkSession, d: str) -> DataFrame:
    def ok(text: str, mode: Mode) -> bool:
        try:
            check_statement(text, mode)
        except Rejected:
            return False
        return True

    return spark.createDataFrame([(str(m), ok("UPDATE t SET a = 1", m), ok("ATTACH 'x' AS y", m)) for m in Mode], "mode string, writes boolean, attach boolean")


@query("policy_bindings", "PL-10 PRJ-24", "SELECT * FROM (VALUES ('named', '3'), ('positional', '7'), ('missing', 'binding'), ('unused', 'binding'), ('range', 'binding'), ('infinite', 'binding')) AS t(name, result)")
def policy_bindings(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark, d)
    cases = [("named", "SELECT :a + :b AS x", {"a": 1, "b": 2}), ("positional", "SELECT ?2 - ?1 AS x", [3, 10]), ("missing", "SELECT :a AS x", {}), ("unused", "SELECT 1 AS x", {"a": 1}), ("range", "SELECT ?3 AS x", [1]), ("infinite", "SELECT :a AS x", {"a": float("inf")})]
    rows = []
    for name, text, values in cases:
        try:
            rows.append((name, str(s.rows(text, values)[0].x)))
        except Rejected as e:
            rows.append((name, e.code))
        except ValueError as e:
            rows.append((name, str(e).split(":")[0]))
    return spark.createDataFrame(rows, "name string, result string")


@query("page_cap", "PL-08 PL-11", "SELECT 'too_large' AS code, 10 AS within")
def page_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_orderkey")
    try:
        capped_rows(rows, most_rows=100)
        code = "none"
    except Rejected as e:
        code = e.code
    return spark.createDataFrame([(code, len(capped_rows(rows.limit(10))))], "code string, within int")


@query("rejection_classes", "PL-11 LG-20 FN-01 SO-07", "SELECT * FROM (VALUES ('overflow', 'error'), ('syntax', 'prepare'), ('unknown', 'prepare'), ('divide', 'error')) AS t(name, code)")
def rejection_classes(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark, d)
    rows = []
    for name, text in (("overflow", "SELECT 9223372036854775807 + id AS x FROM (SELECT CAST(col1 AS BIGINT) AS id FROM VALUES (1) AS v(col1))"), ("syntax", "SELECT FROM WHERE"), ("unknown", "SELECT nothing FROM nation"), ("divide", "SELECT 1 / id AS x FROM (SELECT col1 AS id FROM VALUES (0) AS v(col1))")):
        try:
            s.rows(text)
            rows.append((name, "none"))
        except Rejected as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "name string, code string")


@query("trigger_lint", "FN-09 UF-05", "SELECT true AS raised, false AS quoted")
def trigger_lint(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(has_raise_ignore("BEGIN SELECT raise /* x */ (IGNORE); END"), has_raise_ignore("SELECT 'RAISE(IGNORE)' -- RAISE(IGNORE)"))], "raised boolean, quoted boolean")


_CUSTOMER = Schema({"type": "object", "properties": {"customer": {"type": "integer", "minimum": 0}}, "required": ["customer"]})


@query("named_query", "UF-02 UF-06", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def named_query(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark, d)
    s.define_query("orders_of", _CUSTOMER, lambda view, v: view.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :customer", v))
    return s.query("orders_of", {"customer": 7})


@query("named_command", "UF-03 UF-06 UF-07", "SELECT 'accepted' AS outcome, 'mismatch' AS refused, 1 AS tools")
def named_command(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark, d)
    s.define_command("credit", _CUSTOMER, lambda v: [{"op": "add", "key": str(v["customer"]), "value": 5, "code": None, "topic": None, "payload": None}])
    steps = s.command("credit", {"customer": 1})
    try:
        s.command("credit", {"customer": -1})
        refused = "none"
    except Rejected as e:
        refused = e.code
    ledger = spark.createDataFrame([(1, 1, 1, "credit", 0, [tuple(x[k] for k in ("op", "key", "value", "code", "topic", "payload")) for x in steps])], replay.LEDGER)
    return replay.replay(ledger)[0].select("outcome", F.lit(refused).alias("refused"), F.lit(len(s.tools())).alias("tools"))
