"""Ordered replay of programs whose steps are SQL: upserts, REPLACE, triggers, cascades and recursive queries included.

Outcomes of SQL programs feed back into later ones, statement by statement, which no set operation can express.  A ledger is
therefore dealt by ``grp``, the caller's statement of which programs may see each other's rows, and each group's programs pass in order through
an embedded SQL database of the group (Python's own ``sqlite3``), one task after the other row by row.  What a task holds is one group's
database; the programs themselves stream through (``operators.folds``).

A program runs whole or not at all.  Statements may read and write the group's tables only: the policy refuses attached
databases, settings, transactions, temporary objects and functions that aren't fixed by the transaction; time is the transaction's, in UTC.

Rejections: assert:<code>, constraint, denied, step_limit, too_large, binding, prepare, error, operation_conflict, and whatever code the row brings.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.folds import fold_sorted
from ledgerloom.sources.snapshots import checkpointed

STEP = "struct<sql string, params string, topic string, payload string>"
PROGRAMS = f"idx long, tx_id long, grp string, author string, ts_ms long, steps array<{STEP}>"
STATE = "grp string, tbl string, row string"
#: Bounds of a program and of a statement, and the budget of a statement with how often it is looked at.
MOST_STEPS, MOST_EMITS, BUDGET, LOOK = 256, 64, 1_000_000, 1_000
LIMITS = {sqlite3.SQLITE_LIMIT_SQL_LENGTH: 1_000_000, sqlite3.SQLITE_LIMIT_COLUMN: 256, sqlite3.SQLITE_LIMIT_EXPR_DEPTH: 100, sqlite3.SQLITE_LIMIT_COMPOUND_SELECT: 32, sqlite3.SQLITE_LIMIT_ATTACHED: 0}
#: Functions whose results a transaction doesn't fix, or that reach out of the database.
DENIED_FUNCTIONS = frozenset(("current_date", "current_time", "current_timestamp", "load_extension", "random", "randomblob", "sqlite_compileoption_get", "sqlite_compileoption_used", "sqlite_source_id", "total_changes", "unistr"))
DENIED_ACTIONS = frozenset((
    sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH, sqlite3.SQLITE_PRAGMA, sqlite3.SQLITE_TRANSACTION, sqlite3.SQLITE_SAVEPOINT, sqlite3.SQLITE_CREATE_TEMP_INDEX, sqlite3.SQLITE_CREATE_TEMP_TABLE,
    sqlite3.SQLITE_CREATE_TEMP_TRIGGER, sqlite3.SQLITE_CREATE_TEMP_VIEW,
))
#: Date functions, which take the transaction's time for now.
DATES = ("date", "time", "datetime", "julianday", "unixepoch", "strftime")


class _Refused(Exception):
    """A false assertion."""


class Database:
    """A group's tables, and the transaction that is running on them."""

    def __init__(self, schema: Sequence[str], tables: Sequence[str], budget: int, grp: object):
        self.tables, self.budget, self.grp = tables, budget, grp
        self.con = sqlite3.connect(":memory:", isolation_level=None, cached_statements=256)
        self.plain = sqlite3.connect(":memory:")
        self.row: dict = {"tx_id": 0, "author": None, "ts_ms": 0}
        self.code, self.looks, self.guarded = "", 0, False
        for text in ("PRAGMA recursive_triggers = ON", *schema, "PRAGMA foreign_keys = ON"):
            self.con.execute(text)
        for kind, most in LIMITS.items():
            self.con.setlimit(kind, most)
        for name, n, value in (("actor", 0, lambda: self.row["author"]), ("transaction_id", 0, lambda: self.row["tx_id"]), ("now_ms", 0, lambda: self.row["ts_ms"]), ("assert_that", 2, self._assert)):
            self.con.create_function(name, n, value)
        for name in DATES:
            self.con.create_function(name, -1, partial(self._date, name))
        self.con.set_authorizer(self._allowed)
        self.con.set_progress_handler(self._look, LOOK)

    def _assert(self, condition: object, code: str) -> int:
        if not condition:
            self.code = f"assert:{code}"
            raise _Refused
        return 1

    def _date(self, name: str, *given: object) -> object:
        format_, rest = (given[:1], given[1:]) if name == "strftime" else ((), given)
        now = f"{self.row['ts_ms'] / 1000:.3f}"
        rest = (now, "unixepoch", *rest[1:]) if not rest or str(rest[0]).lower() == "now" else rest
        rest = tuple(x for i, x in enumerate(rest) if not (i and str(x).lower() in ("localtime", "utc")))
        marks = ", ".join("?" * (len(format_) + len(rest)))
        return self.plain.execute(f"SELECT {name}({marks})", (*format_, *rest)).fetchone()[0]

    def _allowed(self, action: int, first: str | None, second: str | None, *_: object) -> int:
        if self.guarded and (action in DENIED_ACTIONS or (action == sqlite3.SQLITE_FUNCTION and (second or "").lower() in DENIED_FUNCTIONS)):
            self.code = "denied"
            return sqlite3.SQLITE_DENY
        return sqlite3.SQLITE_OK

    def _look(self) -> int:
        self.looks += 1
        if self.looks * LOOK <= self.budget:
            return 0
        self.code = "step_limit"
        return 1

    def hold(self, tbl: str, row: str) -> None:
        """Puts a stored row back, past triggers and foreign keys."""
        value = {k: bytes.fromhex(v["hex"]) if isinstance(v, dict) else v for k, v in json.loads(row).items()}
        names = ", ".join(f'"{k}"' for k in value)
        self.con.setconfig(sqlite3.SQLITE_DBCONFIG_ENABLE_TRIGGER, False)
        self.con.execute("PRAGMA foreign_keys = OFF")
        self.con.execute(f'INSERT INTO "{tbl}" ({names}) VALUES ({", ".join("?" * len(value))})', tuple(value.values()))
        self.con.execute("PRAGMA foreign_keys = ON")
        self.con.setconfig(sqlite3.SQLITE_DBCONFIG_ENABLE_TRIGGER, True)

    def _statement(self, text: str, params: str | None) -> int:
        """Runs a statement; returns how many rows it changed, triggers' included."""
        self.code, self.looks, self.guarded = "", 0, True
        before = self.con.total_changes
        try:
            cursor = self.con.execute(text, json.loads(params) if params else ())
            while cursor.fetchmany(1000):
                pass
        finally:
            self.guarded = False
        return self.con.total_changes - before

    def run(self, row: dict) -> tuple[str | None, int | None, int, list[dict]]:
        """(rejection code, failing step, changed rows, emitted events) of a program; nothing stays of a rejected one."""
        self.row = row
        changes, emits = 0, []
        self.con.execute("SAVEPOINT program")
        for at, step in enumerate(row["steps"] or ()):
            code = None
            if at >= MOST_STEPS or len(emits) > MOST_EMITS:
                code = "too_large"
            elif step["sql"] is None:
                emits.append({"ordinal": len(emits), "topic": step["topic"], "payload": step["payload"]})
            else:
                try:
                    changes += self._statement(step["sql"], step["params"])
                except (sqlite3.Error, sqlite3.Warning, ValueError) as e:
                    code = self.code or _code(e)
            if code:
                self.con.execute("ROLLBACK TO program")
                self.con.execute("RELEASE program")
                return code, at, 0, []
        try:
            self.con.execute("RELEASE program")
        except sqlite3.IntegrityError:  # a deferred foreign key
            self.con.execute("ROLLBACK TO program")
            self.con.execute("RELEASE program")
            return "constraint", None, 0, []
        return None, None, changes, emits

    # A fold over the rows of one group.

    def step(self, row: dict) -> Iterable[dict]:
        if row["tbl"] is not None:
            self.hold(row["tbl"], row["row"])
            return
        code, at, changes, emits = (row["code"], None, 0, []) if row["code"] else self.run(row)
        key = {"grp": self.grp, "idx": row["idx"], "tx_id": row["tx_id"]}
        yield key | {"kind": 0, "outcome": "rejected" if code else "accepted", "rejection_code": code, "failing_step": at, "changes": changes}
        yield from (key | {"kind": 2} | e for e in emits)

    def finish(self) -> Iterable[dict]:
        for tbl in self.tables:
            cursor = self.con.execute(f'SELECT * FROM "{tbl}"')
            names = [c[0] for c in cursor.description]
            for row in cursor:
                value = {k: {"hex": v.hex()} if isinstance(v, bytes) else v for k, v in zip(names, row, strict=True)}
                yield {"kind": 1, "grp": self.grp, "tbl": tbl, "row": json.dumps(value, ensure_ascii=False, separators=(",", ":"))}
        self.con.close()
        self.plain.close()


def _code(e: Exception) -> str:
    name = getattr(e, "sqlite_errorname", "") or ""
    if isinstance(e, sqlite3.IntegrityError):
        return "constraint"
    if isinstance(e, sqlite3.ProgrammingError):
        return "prepare" if "one statement" in str(e) else "binding"
    if name == "SQLITE_TOOBIG" or "too many" in str(e) or "too large" in str(e):
        return "too_large"
    if isinstance(e, ValueError):
        return "binding"
    return "prepare" if any(x in str(e) for x in ("syntax error", "no such", "incomplete input", "unrecognized token", "one statement")) else "error"


_FOLDED = "kind int, grp string, idx long, tx_id long, outcome string, rejection_code string, failing_step int, changes long, tbl string, row string, ordinal int, topic string, payload string"


def replay(programs: DataFrame, schema: Sequence[str], tables: Sequence[str], *, state: DataFrame | None = None, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, next state, events) of programs (PROGRAMS) over a state (STATE).

    ``schema``: statements that make a group's tables, indexes, triggers and views; ``tables``: those whose rows are the state.  A program
    with a ``code`` column that isn't null is rejected with that code and doesn't run.  Groups without programs keep their rows.
    """
    code = F.col("code") if "code" in programs.columns else F.lit(None).cast("string")
    rows = programs.select("grp", "idx", "tx_id", "author", "ts_ms", "steps", code.alias("code"), F.lit(None).cast("string").alias("tbl"), F.lit(None).cast("string").alias("row"))
    if state is not None:
        empty = {"idx": "long", "tx_id": "long", "author": "string", "ts_ms": "long", "steps": f"array<{STEP}>", "code": "string"}
        held = state.select("grp", *((F.lit(-1) if c == "idx" else F.lit(None)).cast(k).alias(c) for c, k in empty.items()), "tbl", "row")
        rows = rows.unionByName(held)
    folded = checkpointed(fold_sorted(rows, "grp", ["idx", "tx_id"], partial(Database, tuple(schema), tuple(tables), budget), _FOLDED))
    outcomes = folded.where("kind = 0").select("grp", "idx", "tx_id", "outcome", "rejection_code", "failing_step", "changes")
    return outcomes, folded.where("kind = 1").select("grp", "tbl", "row"), folded.where("kind = 2").select("idx", "tx_id", "ordinal", "topic", "payload")
