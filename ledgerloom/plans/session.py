"""Reading: bound SQL under the policy with fixed result limits, and named queries and commands with validated input."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from ledgerloom.functions.values import bind_value
from ledgerloom.plans.definitions import Schema
from ledgerloom.plans.policy import MOST_BYTES, MOST_COLUMNS, MOST_ROWS, Code, Mode, Rejected, bind, check_plan, check_statement, classify
from ledgerloom.sources.snapshots import SnapshotStore
from ledgerloom.sources.tables import TABLES, read_table


@dataclass
class Session:
    """A read session over tables: a data folder, or the tables of a snapshot store at a revision."""

    spark: SparkSession
    folder: str | None = None
    store: SnapshotStore | None = None
    named_queries: dict[str, tuple[Schema, Callable[[Session, Mapping], DataFrame]]] = field(default_factory=dict)
    named_commands: dict[str, tuple[Schema, Callable[[Mapping], list[dict]]]] = field(default_factory=dict)

    def table(self, name: str, revision: int | None = None) -> DataFrame:
        if self.store is not None:
            return self.store.read(name, revision)
        return read_table(self.spark, self.folder or "", name)

    def sql(self, text: str, parameters: Sequence[object] | Mapping[str, object] | None = None, *, tables: Sequence[str] = (), revision: int | None = None) -> DataFrame:
        """A read as a DataFrame; refused before it runs if the policy, its limits or its bindings don't allow it."""
        found = check_statement(text, Mode.LOCAL_READ)
        values = parameters
        if isinstance(values, Mapping):
            values = {k: bind_value(v) for k, v in values.items()}
        elif values is not None:
            values = [bind_value(v) for v in values]
        bound, args = bind(found, text, values)
        check_plan(self.spark, bound, Mode.LOCAL_READ)
        names = {t.text.strip('"`').lower() for t in found if t.kind in ("word", "name")}
        for name in tables or [t for t in TABLES if t in names]:
            self.table(name, revision).createOrReplaceTempView(name)
        try:
            df = self.spark.sql(bound, args=args or None)
        except Exception as e:
            raise classify(e) from e
        if len(df.columns) > MOST_COLUMNS:
            raise Rejected(Code.TOO_LARGE, "columns")
        return df

    def rows(self, text: str, parameters: Sequence[object] | Mapping[str, object] | None = None, **options) -> list[Row]:
        """The rows of a read, at most MOST_ROWS and MOST_BYTES; more is an error and no part is returned."""
        df = self.sql(text, parameters, **options)
        return capped_rows(df)

    def define_query(self, name: str, schema: Schema, work: Callable[[Session, Mapping], DataFrame]) -> None:
        self.named_queries[name] = (schema, work)

    def define_command(self, name: str, schema: Schema, work: Callable[[Mapping], list[dict]]) -> None:
        self.named_commands[name] = (schema, work)

    def query(self, name: str, value: Mapping) -> DataFrame:
        """A named query over this session."""
        if name not in self.named_queries:
            raise Rejected(Code.DENIED, name)
        schema, work = self.named_queries[name]
        return work(self, schema.validate(value))

    def command(self, name: str, value: Mapping) -> list[dict]:
        """The steps of a named command's program."""
        if name not in self.named_commands:
            raise Rejected(Code.DENIED, name)
        schema, work = self.named_commands[name]
        steps = work(schema.validate(value))
        if not 1 <= len(steps) <= 256 or sum(s.get("op") == "emit" for s in steps) > 64:
            raise Rejected(Code.TOO_LARGE, "program")
        return steps

    def tools(self) -> list[tuple[str, str, dict]]:
        """What can be called by name: (kind, name, input schema)."""
        return sorted([("query", n, s.spec) for n, (s, _) in self.named_queries.items()] + [("command", n, s.spec) for n, (s, _) in self.named_commands.items()], key=lambda t: t[:2])


def capped_rows(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> list[Row]:
    """All rows, if they are within the limits; one row more than allowed is asked for, so nothing is cut silently."""
    try:
        rows = df.limit(most_rows + 1).collect()
    except Exception as e:
        raise classify(e) from e
    if len(rows) > most_rows:
        raise Rejected(Code.TOO_LARGE, "rows")
    size = sum(len(v) if isinstance(v, bytes | bytearray) else len(v.encode()) if isinstance(v, str) else 8 if isinstance(v, int | float | None.__class__) else sys.getsizeof(v) for r in rows for v in r)
    if size > most_bytes:
        raise Rejected(Code.TOO_LARGE, "bytes")
    return rows
