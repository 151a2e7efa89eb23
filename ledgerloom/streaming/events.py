"""Event streams of accepted programs: flattening, topics, cursors, change notices, and reducers, in batch and streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.folds import fold_sorted

MOST_TOPICS, PAGE, MOST_PAGE = 128, 128, 1024


class CursorInvalid(ValueError):
    """The cursor's history, generation or anchor is another one."""


def flatten(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(idx, tx_id, ordinal, topic, payload) of the emits of accepted programs; ordinals count a program's emits from 0."""
    accepted = ledger.join(outcomes.where("outcome = 'accepted'").select("tx_id"), "tx_id", "left_semi")
    emits = F.filter("steps", lambda s: s["op"] == "emit")
    return accepted.select("idx", "tx_id", F.posexplode(emits).alias("ordinal", "s")).select("idx", "tx_id", "ordinal", "s.topic", "s.payload")


def of_topics(events: DataFrame, topics: Sequence[str]) -> DataFrame:
    if len(topics) > MOST_TOPICS:
        raise ValueError("too_large: too many topics")
    return events.where(F.col("topic").isin(*topics)) if topics else events


@dataclass(frozen=True)
class Cursor:
    """A place in a history: everything up to ``index`` is read; ``anchor`` is that transaction's id."""

    history: str
    generation: int
    index: int
    anchor: int | None
    topics: tuple[str, ...]

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"topics": list(self.topics)}, sort_keys=True, separators=(",", ":"))

    @staticmethod
    def parse(text: str) -> Cursor:
        x = json.loads(text)
        return Cursor(x["history"], x["generation"], x["index"], x["anchor"], tuple(x["topics"]))


def page(events: DataFrame, log: DataFrame, *, history: str, generation: int, cursor: Cursor | None = None, topics: Sequence[str] = (), limit: int = PAGE) -> tuple[DataFrame, Cursor]:
    """The events of the next ``limit`` transactions and the cursor after them.  The limit counts transactions, with or without events.

    The cursor's anchor must still stand at its place; a change of generation or topics makes it invalid.
    """
    if not 1 <= limit <= MOST_PAGE:
        raise ValueError("too_large: a page has 1 to 1024 transactions")
    start = 0
    if cursor is not None:
        if (cursor.history, cursor.generation, cursor.topics) != (history, generation, tuple(topics)):
            raise CursorInvalid("history, generation or topics changed")
        start = cursor.index
        if start and not log.where((F.col("idx") == start) & (F.col("tx_id") == cursor.anchor)).limit(1).count():
            raise CursorInvalid("the anchor moved")
    last = log.where((F.col("idx") > start) & (F.col("idx") <= start + limit)).agg(F.max(F.struct("idx", "tx_id")).alias("l")).head().l
    end, anchor = (last.idx, last.tx_id) if last else (start, cursor.anchor if cursor else None)
    rows = of_topics(events.where((F.col("idx") > start) & (F.col("idx") <= end)), topics)
    return rows, Cursor(history, generation, end, anchor, tuple(topics))


def change_notices(changes: DataFrame) -> DataFrame:
    """(batch, revision, recovered) of changes (batch, revision, kind): the latest revision of each batch; a recovery sticks."""
    return changes.groupBy("batch").agg(F.max("revision").alias("revision"), F.bool_or(F.col("kind") == "recovery").alias("recovered"))


Reducer = Callable[[object, dict], object]
#: Projections at once, state bytes, checkpoint bytes.
MOST_PROJECTIONS, MOST_STATE, MOST_CHECKPOINT = 8, 512 << 10, 2 << 20


def state_text(state: object) -> str:
    text = json.dumps(state, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if len(text.encode()) > MOST_STATE:
        raise ValueError("too_large: projection state")
    return text


def _fold(state: object, rows: Iterable[dict], reduce: Reducer) -> object:
    for r in rows:
        state = reduce(state, r)
    return state


def project(events: DataFrame, reduce: Reducer, initial: object, *, key: str = "topic", prior: DataFrame | None = None) -> DataFrame:
    """(key, cursor, state) of a reducer folded over the events of each key in order, from ``prior`` (same columns) if given.

    Rows at or before a key's cursor are skipped, so giving a batch twice changes nothing.
    """
    cols = ["idx", "ordinal", "tx_id", "payload"]
    rows = events.select(F.col(key).cast("string").alias("key"), *cols, F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("cursor"))
    if prior is not None:
        rows = rows.unionByName(prior.select("key", *(F.lit(None).cast(t).alias(c) for c, t in zip(cols, ("long", "int", "long", "string"), strict=True)), "state", "cursor"))

    begin = partial(_Projection, reduce, json.dumps(initial))
    return fold_sorted(rows.withColumn("place", F.coalesce("idx", F.lit(-2))), "key", ["place", "ordinal"], begin, "key string, cursor long, state string")


class _Projection:
    """A reducer over one key's events; a stored state stands before them, under place -2."""

    def __init__(self, reduce: Reducer, initial: str, key: object):
        self.reduce, self.state, self.cursor, self.key = reduce, json.loads(initial), -1, key

    def step(self, row: dict) -> Iterable[dict]:
        if row["state"] is not None:
            self.state, self.cursor, self.reached = json.loads(row["state"]), row["cursor"], row["cursor"]
        elif row["place"] > self.cursor:
            self.state = self.reduce(self.state, {c: row[c] for c in ("idx", "ordinal", "tx_id", "payload")})
            self.reached = row["place"]
        return ()

    reached = -1

    def finish(self) -> Iterable[dict]:
        return ({"key": self.key, "cursor": self.reached, "state": state_text(self.state)},)


@dataclass(frozen=True)
class Definition:
    """A named projection; another version, topics or generation starts it anew."""

    name: str
    version: int
    topics: tuple[str, ...]
    generation: int = 0


def must_reset(stored: Definition | None, wanted: Definition) -> bool:
    return stored != wanted


def stream_projection(stream: DataFrame, reduce: Reducer, initial: object, *, key: str = "topic", name: str, folder: str):
    """The projection over a stream of (idx, ordinal, tx_id, topic, payload): state by key in the query's state store; writes the changed states of each batch as Parquet under ``folder``.

    Events of a batch are folded in order; a batch that runs again after a failure overwrites its own files, so replaying a stream from
    its checkpoint gives the same states.  Read them with ``latest_states(spark.read.parquet(updates_of(folder)))``.
    """

    def fold(key_values: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        cursor, state = held.get if held.exists else (-1, state_text(initial))
        rows = pd.concat(list(batches))
        rows = rows[rows["idx"] > cursor].sort_values(["idx", "ordinal"])
        value = _fold(json.loads(state), rows[["idx", "ordinal", "tx_id", "payload"]].to_dict("records"), reduce)
        cursor = int(rows["idx"].max()) if len(rows) else cursor
        held.update((cursor, state_text(value)))
        yield pd.DataFrame({"key": [key_values[0]], "cursor": [cursor], "state": [state_text(value)]})

    keyed = stream.withColumn("key", F.col(key).cast("string")).groupBy("key")
    out = keyed.applyInPandasWithState(fold, "key string, cursor long, state string", "cursor long, state string", "update", "NoTimeout")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates_of(folder)}/batch={number}")

    return out.writeStream.outputMode("update").foreachBatch(store).queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def updates_of(folder: str) -> str:
    return f"{folder}/updates"


def latest_states(updates: DataFrame) -> DataFrame:
    """The newest state of each key among a stream's updates."""
    return updates.groupBy("key").agg(F.max_by("state", "cursor").alias("state"), F.max("cursor").alias("cursor"))


def settled(events: DataFrame, settled_to: int, changes: DataFrame) -> DataFrame:
    """Events with ``final``; a change at or before the settled place is an error, not a late row to drop."""
    if changes.where(F.col("idx") <= settled_to).limit(1).count():
        raise ValueError("protected_change_required: a settled place changed")
    return events.withColumn("final", F.col("idx") <= settled_to)


def sessions(events: DataFrame, gap_seconds: int, *, key: str, ts: str) -> DataFrame:
    """(key, start, n) of runs of events with gaps of at most ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("__s", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return numbered.groupBy(key, "__s").agg(F.min(ts).alias("start"), F.count("*").alias("n")).drop("__s")
