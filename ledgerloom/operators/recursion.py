"""Recursion with UNION semantics, dependency closure, and orders of small graphs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import checkpointed


class StepLimit(RuntimeError):
    """A recursion that didn't end within its rounds."""

    code = "step_limit"


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], *, max_rounds: int = 100) -> DataFrame:
    """Rows reachable from ``start``: WITH RECURSIVE ... UNION.

    Each round takes the step from the rows that the last one found and keeps what is new by an anti-join over all
    columns; every round's rows are checkpointed, so the plan stays one round long.
    """
    rounds = [checkpointed(start.distinct())]
    for _ in range(max_rounds):
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        new = step(rounds[-1]).distinct().alias("n")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in start.columns]
        new = checkpointed(new.join(seen.alias("s"), same, "left_anti"))
        if not new.limit(1).count():
            return seen
        rounds.append(new)
    raise StepLimit(f"no end after {max_rounds} rounds")


def dependency_closure(roots: DataFrame, edges: Sequence[tuple[str, str, DataFrame]], *, max_rounds: int = 64) -> DataFrame:
    """(tbl, key) of the roots and all rows that depend on them.

    ``edges``: (parent table, child table, rows (parent_key, child_key)) for each foreign key; keys are text.  Null parts refer to nothing.
    """
    every = None
    for parent, child, rows in edges:
        part = rows.dropna().select(F.lit(parent).alias("p_tbl"), F.col("parent_key").alias("p_key"), F.lit(child).alias("c_tbl"), F.col("child_key").alias("c_key"))
        every = part if every is None else every.unionByName(part)
    assert every is not None

    def step(new: DataFrame) -> DataFrame:
        found = new.join(every, (F.col("tbl") == F.col("p_tbl")) & (F.col("key") == F.col("p_key")))
        return found.select(F.col("c_tbl").alias("tbl"), F.col("c_key").alias("key"))

    return fixpoint(roots.select("tbl", "key"), step, max_rounds=max_rounds)


def parents_first(parents: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables in an order in which each follows the tables it refers to; a reference to itself doesn't count; a cycle raises."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(t: str) -> None:
        if state.get(t) == 1:
            raise ValueError(f"cycle through {t}")
        if t in state:
            return
        state[t] = 1
        for p in sorted(set(parents.get(t, ())) - {t}):
            visit(p)
        state[t] = 2
        out.append(t)

    for t in sorted(parents):
        visit(t)
    return out


def ancestry(parent_of: Mapping[str, str | None], head: str) -> list[str]:
    """From the head back to the first generation; a missing parent or a cycle raises."""
    out, at = [], head
    while at is not None:
        if at in out:
            raise ValueError(f"cycle through {at}")
        if at not in parent_of:
            raise ValueError(f"unknown generation {at}")
        out.append(at)
        at = parent_of[at]
    return out
