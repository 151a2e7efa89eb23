"""Ordered replay: programs of typed steps, accepted or rejected as a whole, over keyed state.

A rejected program changes nothing, and that decides about later ones, so outcomes are a fold and not a window sum.  Programs that
touch different keys don't depend on each other: the fold runs in parallel over keys, or over connected components of
keys where programs touch several.  Within a group the order is that of the ledger; a group's rows pass by one after the other
(``operators.folds``), so a task holds the values of one group and never its programs.

Steps: put (set a value), add (change a value; an absent one counts as 0), delete, assert_at_least and assert_present (else
reject with assert:<code>), and emit, which replay skips.  An unknown step rejects with ``denied``; a sum
beyond 64 bits with ``error``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.ledger import history
from ledgerloom.operators.folds import fold_sorted
from ledgerloom.operators.graph import components
from ledgerloom.sources.snapshots import SnapshotStore, checkpointed

STEP = "struct<op string, key string, value long, code string, topic string, payload string>"
LEDGER = f"idx long, tx_id long, author long, operation string, ts_ms long, steps array<{STEP}>"
OUTCOME = "idx long, tx_id long, outcome string, rejection_code string, failing_step int"
MOST_STEPS, MOST_EMITS = 256, 64


class ManifestUnavailable(RuntimeError):
    """A program asks for a validator that isn't there: replay stops, and rejects nothing."""


class ProtectedPrefix(ValueError):
    """An order that changes the final prefix."""


def run_program(state: dict[str, int], steps: Iterable[Mapping[str, object]]) -> tuple[str | None, int | None]:
    """Applies a program to the state, or nothing of it: (rejection code, failing step), both None if accepted."""
    changed: dict[str, int | None] = {}
    get = lambda k: changed[k] if k in changed else state.get(k)
    for i, s in enumerate(steps):
        op, key, value = s["op"], s["key"], s["value"]
        if i >= MOST_STEPS:
            return "too_large", i
        if op == "emit":
            continue
        if op == "put":
            changed[key] = value
        elif op == "add":
            total = (get(key) or 0) + value
            if not -(2**63) <= total < 2**63:
                return "error", i
            changed[key] = total
        elif op == "delete":
            changed[key] = None
        elif op == "assert_at_least":
            at = get(key)
            if at is None or at < value:
                return f"assert:{s['code']}", i
        elif op == "assert_present":
            if get(key) is None:
                return f"assert:{s['code']}", i
        else:
            return "denied", i
    for k, v in changed.items():
        if v is None:
            state.pop(k, None)
        else:
            state[k] = v
    return None, None


class _GroupReplay:
    """The replay of one group: its held values come first, under place -1, then its programs in order."""

    def __init__(self, _: object):
        self.now: dict[str, int] = {}

    def step(self, row: dict) -> Iterable[dict]:
        if row["idx"] < 0:
            self.now[row["key"]] = row["value"]
            return ()
        code, at = ("operation_conflict", None) if row["conflict"] else run_program(self.now, row["steps"] or ())
        return ({"kind": 0, "idx": row["idx"], "tx_id": row["tx_id"], "outcome": "rejected" if code else "accepted", "rejection_code": code, "failing_step": at},)

    def finish(self) -> Iterable[dict]:
        return ({"kind": 1, "key": k, "value": v} for k, v in self.now.items())


def with_groups(ledger: DataFrame) -> DataFrame:
    """The ledger with ``grp``: programs that share a key, directly or through others, share a group."""
    keys = ledger.select("tx_id", F.array_distinct(F.filter(F.transform("steps", lambda s: s["key"]), lambda k: k.isNotNull())).alias("keys"))
    if not keys.where(F.size("keys") > 1).limit(1).count():
        return ledger.join(keys.select("tx_id", F.coalesce(F.get("keys", F.lit(0)), F.lit("")).alias("grp")), "tx_id")
    named = components(keys.where(F.size("keys") > 1).select(F.get("keys", F.lit(0)).alias("a"), F.explode(F.slice("keys", 2, MOST_STEPS)).alias("b")))
    first = keys.select("tx_id", F.coalesce(F.get("keys", F.lit(0)), F.lit("")).alias("node")).join(named, "node", "left")
    return ledger.join(first.select("tx_id", F.coalesce("component", "node").alias("grp")), "tx_id")


def replay(ledger: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, next state) of a ledger over a state (key, value).

    A second use of an operation by its author rejects with operation_conflict whether or not the first was accepted.
    """
    spark = ledger.sparkSession
    state = spark.createDataFrame([], "key string, value long") if state is None else state
    ordered = with_groups(ledger if "conflict" in ledger.columns else history.operation_conflicts(ledger))
    touched = ordered.select("grp", F.explode(F.transform("steps", lambda s: s["key"])).alias("key")).dropna().distinct()
    rows = ordered.select("grp", "idx", "tx_id", "conflict", "steps", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("value"))
    held = state.join(touched, "key").select("grp", F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("long").alias("tx_id"), F.lit(False).alias("conflict"), F.lit(None).cast(f"array<{STEP}>").alias("steps"), "key", "value")

    folded = checkpointed(fold_sorted(rows.unionByName(held), "grp", ["idx", "tx_id"], _GroupReplay, f"kind int, {OUTCOME}, key string, value long"))
    outcomes = folded.where("kind = 0").select("idx", "tx_id", "outcome", "rejection_code", F.col("failing_step").cast("int").alias("failing_step"))
    untouched = state.join(touched.select("key").distinct(), "key", "left_anti")
    return outcomes, folded.where("kind = 1").select("key", "value").unionByName(untouched)


def without_sql(ledger: DataFrame) -> DataFrame:
    """Outcomes of a ledger under an executor without a database: only emits are allowed, anything else rejects; no fold is needed."""
    marked = history.operation_conflicts(ledger)
    place = F.array_position(F.transform("steps", lambda s: s["op"] == "emit"), F.lit(False))
    code = F.when(F.col("conflict"), "operation_conflict").when(place > 0, "profile:sql-disabled")
    return marked.select("idx", "tx_id", F.when(code.isNull(), "accepted").otherwise("rejected").alias("outcome"), code.alias("rejection_code"), F.when(~F.col("conflict") & (place > 0), (place - 1).cast("int")).alias("failing_step"))


@dataclass(frozen=True)
class Revision:
    number: int
    length: int
    base: int
    replayed: int
    content_hash: str


@dataclass
class Materializer:
    """Revisions of a replayed ledger: appends, late arrivals, checkpoints, and a final prefix that can't change."""

    spark: SparkSession
    store: SnapshotStore
    every: int = 100
    keep: int = 16
    manifests: frozenset[str] = frozenset({"default"})
    final: int = 0
    head: Revision | None = None
    checkpoints: dict[int, int] = field(default_factory=dict)  # prefix length -> revision that has its state

    def bootstrap(self, state: DataFrame | None = None) -> Revision:
        """The state before the first transaction."""
        state = self.spark.createDataFrame([], "key string, value long") if state is None else state
        log = self.spark.createDataFrame([], f"{LEDGER}, outcome string, rejection_code string, failing_step int")
        return self._publish(0, state, log, 0, 0)

    def _publish(self, length: int, state: DataFrame, log: DataFrame, base: int, replayed: int) -> Revision:
        number = self.head.number + 1 if self.head else 0
        self.store.publish(number, {"state": state, "log": log})
        digest = self.store.read("state", number).agg(F.sum(F.xxhash64("key", "value").cast("decimal(38,0)")).alias("h")).head().h
        self.head = Revision(number, length, base, replayed, str(digest))
        if length == 0 or length - max(self.checkpoints) >= self.every:
            self.checkpoints[length] = number
        for old in sorted(k for k in self.checkpoints if k)[: -self.keep]:
            del self.checkpoints[old]
        self.store.retain(1, always=tuple(self.checkpoints.values()))
        return self.head

    def materialize(self, ordered: DataFrame, manifest: str = "default") -> Revision | None:
        """Replays what the order changes, from the nearest checkpoint before its first difference; None if nothing differs.

        ``ordered``: LEDGER rows with places 1, 2, ...
        """
        if self.head is None:
            self.bootstrap()
        if manifest not in self.manifests:
            raise ManifestUnavailable(manifest)
        ordered = checkpointed(history.operation_conflicts(ordered))
        problems = [r.problem for r in history.invalid_inputs(ordered).collect()]
        if problems:
            raise ValueError("mismatch: " + ", ".join(sorted(problems)))
        if not history.contiguity(ordered).head().contiguous:
            raise ValueError("mismatch: places aren't 1 to n")
        log = self.store.read("log")
        digest = lambda df: df.select("idx", F.struct("tx_id", "author", "operation", "ts_ms", F.to_json("steps")).alias("body"))
        first = history.earliest_difference(digest(log), digest(ordered), "body").head().idx
        if first is None:
            return None
        if first <= self.final:
            raise ProtectedPrefix(f"protected_change_required: place {first} is final")
        length = ordered.count()
        base = history.base_of([k for k in self.checkpoints], first, length)
        # A plain append goes on from the newest state, whatever the checkpoints.
        if first == self.head.length + 1:
            base, state = self.head.length, self.store.read("state")
        else:
            state = self.store.read("state", self.checkpoints[base])
        suffix = ordered.where(F.col("idx") > base)
        outcomes, state = replay(suffix, state)
        new = suffix.drop("conflict").join(outcomes.drop("tx_id"), "idx")
        kept = log.where(F.col("idx") <= base)
        return self._publish(length, state, kept.unionByName(new.select(*kept.columns)), base, length - base)

    def finalize(self, length: int) -> None:
        """Makes a prefix final; it never shrinks, and must be materialized."""
        if length < self.final or self.head is None or length > self.head.length:
            raise ValueError("mismatch: not a longer materialized prefix")
        self.final = length

    def final_log(self) -> DataFrame:
        return self.store.read("log").where(F.col("idx") <= self.final)

    def local_log(self, revision: int | None = None) -> DataFrame:
        return self.store.read("log", revision)
