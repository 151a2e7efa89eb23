"""Ordered histories: the total order, validation, differences, and selection across generations.

A ledger is a DataFrame with at least (idx, tx_id, author, operation, ts_ms).  All checks are set operations: none walks the
history on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_events(events: DataFrame) -> DataFrame:
    """A ledger made of events: the author is the user, an operation is an event type and day, a purchase debits its value in cents, anything else credits a quarter."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select(
        F.col("event_id").alias("tx_id"), F.col("user_id").alias("author"), F.concat_ws(":", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("operation"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_type") == "purchase", -cents).otherwise(F.call_function("div", cents, F.lit(4).cast("long"))).alias("amount"),
        "event_type", "props",
    )


def total_order() -> list[Column]:
    """Transactions stand in order of time, author and id."""
    return [F.col("ts_ms"), F.col("author"), F.col("tx_id")]


def with_index(ledger: DataFrame, name: str = "idx") -> DataFrame:
    """Places 1, 2, ... in the total order: ranks within ranges of the order, offset by the ranges' counts."""
    from ledgerloom.operators.writes import with_row_ids

    return with_row_ids(ledger, ["ts_ms", "author", "tx_id"], 0, name)


def operation_conflicts(ledger: DataFrame) -> DataFrame:
    """The ledger with ``conflict``: the author has used the operation before."""
    w = Window.partitionBy("author", "operation").orderBy(*total_order())
    return ledger.withColumn("conflict", F.row_number().over(w) > 1)


def invalid_inputs(ledger: DataFrame, digest: Column | None = None) -> DataFrame:
    """(problem, n): repeated transaction ids, null parts, and digests that don't match their bodies."""
    repeated = ledger.groupBy("tx_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("problem"), "n")
    null = ledger.where("tx_id IS NULL OR author IS NULL OR operation IS NULL OR ts_ms IS NULL OR ts_ms < 0").agg(F.count("*").alias("n")).select(F.lit("incomplete").alias("problem"), "n")
    out = repeated.unionByName(null)
    if digest is not None:
        out = out.unionByName(ledger.where(F.col("digest") != digest).agg(F.count("*").alias("n")).select(F.lit("digest").alias("problem"), "n"))
    return out.where("n > 0")


def identity_conflicts(known: DataFrame, given: DataFrame) -> DataFrame:
    """Transaction ids that are in both with different digests."""
    return known.select("tx_id", F.col("digest").alias("known")).join(given.select("tx_id", F.col("digest").alias("given")), "tx_id").where("known <> given")


def outcome_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tx_id, before, after) of transactions whose outcome differs between two revisions; null where one lacks it."""
    both = before.select("tx_id", F.col("outcome").alias("before")).join(after.select("tx_id", F.col("outcome").alias("after")), "tx_id", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def earliest_difference(a: DataFrame, b: DataFrame, value: str = "tx_id") -> DataFrame:
    """One row: the first place where two ordered lists differ, null if nowhere."""
    both = a.select("idx", F.col(value).alias("va")).join(b.select("idx", F.col(value).alias("vb")), "idx", "full_outer")
    return both.where(~F.col("va").eqNullSafe(F.col("vb"))).agg(F.min("idx").alias("idx"))


def contiguity(log: DataFrame) -> DataFrame:
    """One row: count, greatest place, and whether places are 1 to count."""
    row = log.agg(F.count("*").alias("n"), F.coalesce(F.max("idx"), F.lit(0)).alias("top"), F.count_distinct("idx").alias("places"), F.coalesce(F.min("idx"), F.lit(1)).alias("low"))
    return row.select("n", "top", ((F.col("n") == F.col("top")) & (F.col("places") == F.col("n")) & (F.col("low") == 1)).alias("contiguous"))


def checkpoint_plan(length: int, every: int = 100, keep: int = 16) -> list[int]:
    """Prefix lengths that have a checkpoint after a history of ``length``: the empty one, and the newest ``keep`` multiples of ``every``."""
    return [0, *range(every, length + 1, every)][:1] + [*range(every, length + 1, every)][-keep:]


def base_of(checkpoints: list[int], first_difference: int | None, length: int) -> int:
    """The longest checkpointed prefix before the first difference (places from 1)."""
    limit = length if first_difference is None else first_difference - 1
    return max(c for c in checkpoints if c <= limit)


def chain_breaks(chain: DataFrame) -> DataFrame:
    """Rows of (generation, seq, previous_root, root) that don't follow the row before them."""
    w = Window.partitionBy("generation").orderBy("seq")
    row = chain.withColumn("before_seq", F.lag("seq").over(w)).withColumn("before_root", F.lag("root").over(w))
    ok = F.when(F.col("before_seq").isNull(), F.col("previous_root").isNull()).otherwise((F.col("seq") == F.col("before_seq") + 1) & F.col("previous_root").eqNullSafe(F.col("before_root")))
    return row.where(~ok).select("generation", "seq")


def equivocations(chain: DataFrame) -> DataFrame:
    """Positions that have several roots."""
    return chain.groupBy("generation", "seq").agg(F.count_distinct("root").alias("roots")).where("roots > 1")


def selected_history(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Records of the selected path: those of each segment's generation up to its cutoff, with their segment's place.

    ``segments``: (segment, generation, cutoff); a cutoff of null takes the generation whole.
    """
    joined = records.join(segments, "generation").where(F.col("cutoff").isNull() | (F.col("seq") <= F.col("cutoff")))
    return joined.drop("cutoff")


def operation_states(saved: DataFrame, applied: DataFrame, abandoned: DataFrame, selected: DataFrame) -> DataFrame:
    """(tx_id, state) of saved operations: applied, abandoned, needs_reapply (applied once, no longer selected) or saved."""
    flag = lambda df, n: df.select("tx_id").distinct().withColumn(n, F.lit(True))
    joined = saved.select("tx_id").distinct().join(flag(applied, "a"), "tx_id", "left").join(flag(abandoned, "b"), "tx_id", "left").join(flag(selected, "s"), "tx_id", "left")
    state = F.when(F.col("b"), "abandoned").when(F.col("a") & F.col("s"), "applied").when(F.col("a"), "needs_reapply").otherwise("saved")
    return joined.select("tx_id", state.alias("state"))


def coverage(reports: DataFrame, point: int) -> DataFrame:
    """Peers whose latest report (peer, seq, point) is at ``point`` or after it."""
    latest = reports.groupBy("peer").agg(F.max_by("point", "seq").alias("point"))
    return latest.where(F.col("point") >= point)


def as_of(rows: DataFrame, controls: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the latest control at or before their place: one window over both, so hot keys sort and don't multiply."""
    packed = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(order).alias("o"))
    kind = packed.schema["row"].dataType
    both = packed.select("k", "o", F.lit(1).alias("kind"), "row", F.lit(None).cast("string").alias("control")).unionByName(
        controls.select(F.col(key).alias("k"), F.col(order).alias("o"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("row"), F.col("control").cast("string").alias("control"))
    )
    w = Window.partitionBy("k").orderBy("o", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("control", F.last("control", ignorenulls=True).over(w)).where("kind = 1").select("row.*", "control")


def export_range(ledger: DataFrame, *, after: int = 0, limit: int = 1024, max_bytes: int = 1 << 20, size: str = "bytes") -> DataFrame:
    """Rows after a place: ``limit`` at most, and as many as their running size allows; the first always fits."""
    page = ledger.where(F.col("idx") > after).orderBy("idx").limit(limit)  # bounded by limit
    total = F.sum(size).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("total", total).where((F.col("total") <= max_bytes) | (F.col("total") == F.col(size))).drop("total")
