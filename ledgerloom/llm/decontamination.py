"""Benchmark decontamination (op 7): winnowed fingerprints, with DataFrame functions only.

A benchmark item's windows are its runs of ``WINDOW`` words; an item of fewer words is one window.  Every window keeps the
smallest hash of its grams of ``GRAM`` words.  A document keeps the smallest hash of every run of as many grams as a
window has, so a document that holds a window shares its fingerprint: the join of the two sets of fingerprints misses no
document.  The hits are then extended: in the candidates, every run of words of a window's length is compared
with the windows word by word, and the words that matching runs cover are counted.

The benchmark's windows are broadcast while their words, ids and fingerprints take under ``BROADCAST_BYTES``, which is counted; beyond that
Spark's shuffle join takes the same plan.  Fingerprints are taken from fully lower-cased words, whose equality follows from that of the compared words.

Defined results: a null or empty text has no words, isn't hit and isn't contaminated; very long texts are split into words whole; a null item
has no windows; rows of the same doc_id and text are judged alike and each returned; items with the same id count once; a null item_id counts
in ``contaminated`` but has no place in ``n_items``; extra columns, whatever their names, are ignored or kept as they are; an empty table
gives no rows; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, GRAM = 13, 5
BROADCAST_BYTES = 32 << 20

#: Fixed value: what separates words, every ASCII character but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column, lower: Column | None = None) -> Column:
    """The words of a text, of which A-Z are lower-cased; empty for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase) if lower is None else lower
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often a lambda in the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(words: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order; an empty array if there are fewer words."""
    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _fingerprints(words: Column, length: int) -> Column:
    """Smallest gram hash of each run of ``length`` words, without repetitions."""
    k = min(GRAM, length)
    w = length - k + 1

    def smallest(g: Column) -> Column:
        return F.when(F.size(g) >= w, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (w - 1)), lambda i: F.array_min(F.slice(g, i, w))))).otherwise(F.array().cast("array<bigint>"))

    return _let(_grams(words, k), smallest)


def benchmark_windows(benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(item_id, length, words, fingerprint) of every window of every item."""
    items = benchmark.select(F.col("item_id"), word_array(F.col("text").cast("string")).alias("w"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    items = items.select("item_id", "w", word_array(F.col("low"), F.col("low")).alias("l"), F.least(F.size("w"), F.lit(window)).alias("length")).where("length > 0")
    items = items.select("item_id", "length", "w", "l", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    run = items.select("item_id", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("words"), F.slice("l", F.col("at"), F.col("length")).alias("l"))
    smallest = F.lit(None).cast("long")
    for n in range(1, window + 1):
        smallest = F.when(F.col("length") == n, F.array_min(_grams(F.col("l"), min(GRAM, n)))).otherwise(smallest)
    return run.select("item_id", "length", "words", smallest.alias("fingerprint")).distinct()


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Contaminated: at least one word in ``share`` is hit.
    """
    base = _keyed(docs, id_col, text_col)
    return _judged(base, benchmark, window, share).drop("id_key", "text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    bad = _judged(_keyed(docs, id_col, text_col), benchmark, window, share).where("contaminated").select("id_key", "text_key").distinct()
    id_key, text_key = _keys(id_col, text_col)
    return docs.select(F.struct("*").alias("rest"), id_key.alias("id_key"), text_key.alias("text_key")).join(bad, ["id_key", "text_key"], "left_anti").select("rest.*")


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_key, text_key = _keys(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), id_key.alias("id_key"), text_key.alias("text_key"))


def _judged(base: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    windows = benchmark_windows(benchmark, window=window)
    row_bytes = F.octet_length("words") + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 64  # with what a hashed row takes
    found = windows.groupBy("length").agg(F.sum(row_bytes.cast("long")).alias("size")).collect()  # at most ``window`` rows
    lengths, size = sorted(r["length"] for r in found), sum(r["size"] for r in found)

    low = base.select("id_key", "text_key", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    low = low.select("id_key", "text_key", word_array(F.col("low"), F.col("low")).alias("l"))
    prints = [_fingerprints(F.col("l"), n) for n in lengths] or [F.array().cast("array<bigint>")]
    prints = low.select("id_key", "text_key", F.explode(F.array_distinct(F.concat(*prints))).alias("fingerprint"))
    candidates = prints.join(_small(windows.select("fingerprint").distinct(), size), "fingerprint", "left_semi").select("id_key", "text_key").distinct()

    runs = base.join(candidates, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"])
    runs = runs.select("id_key", "text_key", word_array(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("length"))
    runs = runs.where(F.size("w") >= F.col("length"))
    runs = runs.select("id_key", "text_key", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("start"))
    runs = runs.select("id_key", "text_key", "length", "start", F.array_join(F.slice("w", F.col("start"), F.col("length")), " ").alias("words"))
    by_words = windows.groupBy("length", "words").agg(F.collect_set("item_id").alias("items"))
    hits = runs.join(_small(by_words, size), ["length", "words"])

    key = ["id_key", "text_key"]
    order = Window.partitionBy(*key).orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), reached))
    covered = hits.select(*key, "items", fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    out = base.select("doc_id", *key, F.size(word_array(F.col("text"))).cast("long").alias("n_words")).join(covered, key, "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce(F.transform("items", lambda i: i.cast("string")), F.array().cast("array<string>"))
    digest = F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)
    return out.select("id_key", "text_key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), digest.alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
