"""Quality rules (op 9): text statistics, and a learned ordered decision list that becomes one Spark CASE expression.

``text_statistics`` computes, for every whole text, the base counts.  ``learn_rules`` grows and prunes
threshold conjunctions by sequential covering on labelled statistics: a rule grows literal by literal
by FOIL gain on two thirds of the sample, loses final literals while that helps on the other third, and is
kept if it is right often enough; what it covers leaves the sample and the next rule is sought.
``RuleList.verdict`` is the list as nested ``when`` expressions, so that scoring stays in the JVM.

Defined results: a null or empty text has no words and fails the base rule; very long texts are counted whole; a null id is returned as null;
of literals with equal gain the first feature's lowest threshold is taken; repeated rows give repeated result rows; extra columns, whatever
their names, are ignored; an empty table gives no rows; without labels the list is empty and keeps what the base rule keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _arrays as A
from ledgerloom.llm._spark import held_out

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Names and Spark expressions of what the rules compare with thresholds.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1L)",
    "symbol_share": "n_symbols / greatest(n_words, 1L)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1L)",
    "capital_share": "n_capitals / greatest(word_chars, 1L)",
    "mark_share": "n_marks / greatest(n_words, 1L)",
}
MARKS = np.zeros(256, bool)
MARKS[np.frombuffer(b"!?.,;:", np.uint8)] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[0x41:0x5B] = True

#: Labelled documents that the rules are learned from, at most.
SAMPLE_ROWS = 20_000


def _repeats_in_document(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row: does the same key occur in another row of the same document?  And is it a later one?"""
    both = A.join2(docs.astype(np.uint64), keys)
    order = A.stable_order(both)
    s = both[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(keys), np.uint8)
    again[order[1:][same]] = 2  # equal to an earlier one
    firsts = order[:-1][same]
    again[firsts[again[firsts] == 0]] = 1
    return again


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each document of a batch of UTF-8 buffers."""
    n = len(offsets) - 1
    starts, ends, first = A.words(data, offsets)
    n_words = np.diff(first)
    at = lambda flags: A.segment_sums(flags, offsets)
    points = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": at(points & ~A.SPACE[data]), "n_symbols": at(SYMBOLS[data]), "n_capitals": at(CAPITALS[data]), "n_marks": at(MARKS[data])}
    ls, le, lfirst = A.lines(data, offsets)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    docs = np.repeat(np.arange(n), np.diff(lfirst))[has_word]
    later = _repeats_in_document(A.span_hashes(data, ls[has_word], le[has_word]), docs) == 2
    out["n_dup_lines"] = np.bincount(docs[later], minlength=n).astype(np.int64)
    doc_of = np.repeat(np.arange(n), n_words)
    h = A.window_hashes(A.span_hashes(data, starts, ends), 3)
    inside = np.flatnonzero(doc_of[2:] == doc_of[:-2]) if len(doc_of) > 2 else np.zeros(0, np.int64)
    repeated = inside[_repeats_in_document(h[inside], doc_of[inside]) > 0]
    out["n_repeat_words"] = A.segment_sums(A.cover(len(doc_of), repeated, 3), first)
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks) of every text."""
    names = [*STATISTICS, "n_capitals", "n_marks"]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.string_buffers(batch.column(1))
            for lo, hi, d, o in A.pieces(data, offsets):
                s = statistics_of(d, o)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(s[k], pa.int64()) for k in names)], names=["doc_id", *names])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(stats, "doc_id long, " + ", ".join(f"{k} long" for k in names))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool  # x > threshold, else x <= threshold
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def expression(self) -> Column:
        v = F.expr(FEATURES[self.feature])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class RuleList:
    """Ordered rules; the first whose literals all hold rejects the text, and what no rule covers is kept."""

    rules: tuple[tuple[Literal, ...], ...]

    def verdict(self) -> Column:
        out = None
        for rule in self.rules:
            both = F.lit(True)
            for literal in rule:
                both = both & literal.expression()
            out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def keeps(self, x: np.ndarray) -> np.ndarray:
        names, kept = list(FEATURES), np.ones(len(x), bool)
        for rule in self.rules:
            kept &= ~np.logical_and.reduce([t.holds(x, names) for t in rule])
        return kept

    def __str__(self) -> str:
        return "\n".join("drop if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def learn_rules(x: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_literals: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> RuleList:
    """Sequential covering of the rows that ``bad`` marks.  x: one row of FEATURES for each text."""
    names, rules = list(FEATURES), []
    order = np.random.default_rng(7).permutation(len(x))
    x, bad = x[order], bad[order].astype(bool)
    grow = np.arange(len(x)) % 3 != 2

    def best_literal(x, bad):
        p0, n0 = bad.sum(), (~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, name in enumerate(names):
            v = x[:, j]
            o = np.argsort(v, kind="stable")
            sv, sb = v[o], bad[o]
            edge = np.flatnonzero(sv[1:] > sv[:-1])
            if not len(edge):
                continue
            p, n = np.cumsum(sb)[edge], np.cumsum(~sb)[edge]
            for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Literal(name, above, float((sv[edge[i]] + sv[edge[i] + 1]) / 2)))
        return best[1]

    def covered(rule, x):
        return np.logical_and.reduce([t.holds(x, names) for t in rule]) if rule else np.ones(len(x), bool)

    def worth(rule, x, bad):
        c = covered(rule, x)
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / max(1, p + n), p, n

    left, sought = np.ones(len(x), bool), np.ones(len(x), bool)
    for _ in range(4 * max_rules):
        g, t = left & grow & (sought | ~bad), left & ~grow
        if len(rules) == max_rules or bad[g].sum() < min_cover:
            break
        rule: list[Literal] = []
        gx, gb = x[g], bad[g]
        while gb.any() and (~gb).any() and len(rule) < max_literals:
            literal = best_literal(gx, gb)
            if literal is None:
                break
            rule.append(literal)
            c = literal.holds(gx, names)
            gx, gb = gx[c], gb[c]
        while len(rule) > 1 and worth(rule[:-1], x[t], bad[t])[0] >= worth(rule, x[t], bad[t])[0]:
            rule.pop()
        _, p, n = worth(rule, x[left], bad[left])
        _, tp, tn = worth(rule, x[t], bad[t])
        if not rule:
            break
        if p < min_cover or p < min_precision * (p + n) or tp < min_precision * (tp + tn):
            sought &= ~covered(rule, x)  # not worth a rule: the next one looks for others
            continue
        rules.append(tuple(rule))
        left &= ~covered(rule, x)
    return RuleList(tuple(rules))


def _base_failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, min_words: int = 50, max_repeat_percent: int = 50) -> RuleList:
    """Rules from at most ``sample_rows`` labelled documents that aren't held out, taken in the order of a hash of their ids.

    Documents that fail the base rule are left out, as the list decides about the others.
    """
    doc_id = F.col("doc_id").cast("long")
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(doc_id.alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = chosen.collect()
    if not rows:
        return RuleList(())
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in rows], "doc_id long, quality int")
    sample = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    stats = text_statistics(sample).where(~_base_failed(min_words, max_repeat_percent)).select("doc_id", *(F.expr(e).alias(k) for k, e in FEATURES.items()))
    got = stats.limit(2 * sample_rows).toPandas().sort_values(["doc_id", *FEATURES]).drop_duplicates("doc_id")
    quality = got["doc_id"].map({r.doc_id: r.quality for r in rows})
    return learn_rules(got[list(FEATURES)].to_numpy(float), quality.to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: RuleList, *, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document."""
    stats = text_statistics(docs).withColumn("base_failed", _base_failed(min_words, max_repeat_percent))
    return stats.withColumn("kept", ~F.col("base_failed") & rules.verdict()).select("doc_id", *STATISTICS, "base_failed", "kept")
