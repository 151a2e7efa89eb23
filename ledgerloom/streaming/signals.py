"""Live signals: sequence-numbered messages with a time to live, in batch and streaming.

Columns: author, session, sequence, topic, payload, issued_ms, expires_ms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Default and greatest time to live, tolerated clock difference, a subscription's bounds.
TTL_MS, MOST_TTL_MS, SKEW_MS = 30_000, 60_000, 5_000
MOST_PENDING, MOST_PENDING_BYTES = 64, 256 << 10


class Overflow(RuntimeError):
    """A subscription that has more pending messages than its bound: an error, never a silent loss."""


def dedupe(signals: DataFrame) -> DataFrame:
    """The first of each (author, session, sequence) to be issued."""
    w = Window.partitionBy("author", "session", "sequence").orderBy("issued_ms", "payload")
    return signals.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedupe_stream(signals: DataFrame, *, ts: str, ttl: str = "60 seconds") -> DataFrame:
    """The same over a stream: keys are remembered for a message's longest life."""
    return signals.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["author", "session", "sequence"])


def alive(signals: DataFrame, now_ms: int) -> DataFrame:
    """Messages that haven't expired, don't live too long, and weren't issued in the future beyond the tolerance."""
    life = F.col("expires_ms") - F.col("issued_ms")
    return signals.where((F.col("expires_ms") > now_ms) & (life > 0) & (life <= MOST_TTL_MS) & (F.col("issued_ms") <= now_ms + SKEW_MS))


def select(signals: DataFrame, selectors: Sequence[Mapping[str, str]]) -> DataFrame:
    """Messages that match any selector; a selector matches if all of its fields are equal."""
    any_ = F.lit(False)
    for s in selectors:
        every = F.lit(True)
        for k, v in s.items():
            every = every & F.col(k).eqNullSafe(F.lit(v))
        any_ = any_ | every
    return signals.where(any_)


def latest(signals: DataFrame, keys: Sequence[str] = ("author", "topic")) -> DataFrame:
    """The message with the highest sequence of each key; an older one that comes later doesn't win."""
    rest = [c for c in signals.columns if c not in keys]
    return signals.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("sequence", "issued_ms")).alias("l")).select(*keys, "l.*")


def all_pending(signals: DataFrame, subscriber: str, *, most: int = MOST_PENDING, most_bytes: int = MOST_PENDING_BYTES) -> DataFrame:
    """(subscriber, pending, bytes, overflow) of the messages that each subscriber has to take."""
    size = F.octet_length(F.coalesce("payload", F.lit("")))
    out = signals.groupBy(subscriber).agg(F.count("*").alias("pending"), F.sum(size).cast("long").alias("bytes"))
    return out.withColumn("overflow", (F.col("pending") > most) | (F.col("bytes") > most_bytes))


def take_all(signals: DataFrame, subscriber: str, **bounds: int) -> DataFrame:
    """The messages in order, or Overflow if a subscriber's bound is passed."""
    lost = all_pending(signals, subscriber, **bounds).where("overflow").limit(1).collect()
    if lost:
        raise Overflow(str(lost[0][0]))
    return signals.orderBy(subscriber, "issued_ms", "sequence")
