"""Toxicity (op 8): a convolutional text classifier over hashed word embeddings, trained and run in numpy.

A word (lower-cased run of letters and digits) is hashed three times: whole, and by its first six and first seven bytes
together with whether it goes on after them.  The three table rows together are its embedding, so that inflected
forms share most of it.  Filters of widths 1, 2 and 3 slide over the whole text; each filter's maximum over a block of words is
pooled again by the maximum and the mean over the blocks, and a logistic layer gives the score.  The tables start from
each bucket's association with the label, counted on one part of the sample; the network is trained by Adam on a second
part.  All labelled documents that neither part has calibrate, with classes weighted by their true counts: for each language
the logits are moved so that the threshold of best F1 becomes ``DECISION``.  The language is that of the compression classifier on the text itself, never the column.

Defined results: a null or empty text gets the score of a text without words; very long texts are convolved whole, block by block; equal
texts get equal scores, repeated rows repeat results; extra columns, whatever their names, are ignored; an empty table gives no rows; without
labels of both classes every score is 0; a null label doesn't count, and of several labels of one doc_id each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _arrays as A
from ledgerloom.llm._spark import held_out
from ledgerloom.llm.language_id import LanguageModel

DECISION = 0.3
BUCKETS, TABLES, DEPTH, FILTERS, WIDTHS, BLOCK = 1 << 18, 3, 6, 6, (1, 2, 3), 64
#: Labelled documents that the tables and filters may learn from: of each class, at most.
SAMPLE_TOXIC, SAMPLE_OTHER = 1_500, 3_000
STEPS, LIMIT = 64, 40  # calibration counts logits in steps of 1 / STEPS, within +-LIMIT
PAD = 2  # empty words at least on either side of a document, so that no filter sees two


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word (words x TABLES), and the first word of each document."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, offsets, A.ALNUM)
    length, mask = ends - starts, np.uint64(BUCKETS - 1)
    out = np.empty((len(starts), TABLES), np.int32)
    out[:, 0] = A.span_hashes(low, starts, ends) & mask
    for t, n in ((1, 6), (2, 7)):
        out[:, t] = A.mix(A.span_hashes(low, starts, np.minimum(ends, starts + n)) + np.uint64(t) + (length > n)) & mask
    return out, first


@dataclass
class Network:
    tables: np.ndarray  # TABLES x (BUCKETS + 1) x DEPTH; the last row is zero
    filters: list[np.ndarray]  # for each width: width x TABLES * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # for the maxima, for the means, and a constant
    shift: float = 0.0
    language_shift: dict[str, float] = field(default_factory=dict)
    languages: LanguageModel = field(default_factory=lambda: LanguageModel(()))

    def padded(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every document's words within whole blocks, PAD empty words at least on either side; and its first block."""
        blocks = -(-(np.diff(first) + 2 * PAD) // BLOCK)
        begin = np.concatenate([[0], np.cumsum(blocks)])
        out = np.full((begin[-1] * BLOCK, TABLES), BUCKETS, np.int32)
        out[np.repeat(begin[:-1] * BLOCK + PAD - first[:-1], np.diff(first)) + np.arange(len(buckets))] = buckets
        return out, begin

    def embed(self, padded: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[t][padded[:, t]] for t in range(TABLES)], 1)

    def responses(self, e: np.ndarray) -> list[np.ndarray]:
        """For each width, every filter at every place where it starts (blocks x BLOCK x FILTERS)."""
        every = e @ np.concatenate([w for f in self.filters for w in f], 1)
        out, column = [], 0
        for width in WIDTHS:
            total = every[:, column : column + FILTERS].copy()
            for o in range(1, width):
                total[:-o] += every[o:, column + o * FILTERS : column + (o + 1) * FILTERS]
            out.append(total.reshape(-1, BLOCK, FILTERS))
            column += width * FILTERS
        return out

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Unmoved logits of whole documents."""
        if len(first) < 2:
            return np.zeros(0)
        padded, begin = self.padded(buckets, first)
        hidden = np.maximum(np.concatenate([r.max(1) for r in self.responses(self.embed(padded))], 1) + self.bias, 0)
        most, mean = np.maximum.reduceat(hidden, begin[:-1], axis=0), np.add.reduceat(hidden, begin[:-1], axis=0) / np.diff(begin)[:, None]
        return np.concatenate([most, mean], 1) @ self.out[:-1] + self.out[-1]


def _begin(docs: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> Network:
    """Tables from each bucket's association with the label, by documents that hold it."""
    tables = np.zeros((TABLES, BUCKETS + 1, DEPTH), np.float32)
    p = toxic.mean()
    for t in range(TABLES):
        hit, seen = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for d, y in zip(docs, toxic, strict=True):
            own = np.unique(d[:, t])
            seen[own] += 1
            hit[own] += y
        found = seen > 0
        z = (hit - seen * p) / np.sqrt(seen * p * (1 - p) + 1)
        tables[t, :-1][found] = rng.normal(0, 0.02, (found.sum(), DEPTH))
        tables[t, :-1, 0] += np.clip(z, -2, 12) / 6
    filters = []
    for width in WIDTHS:
        f = rng.normal(0, 0.1, (width, TABLES * DEPTH, FILTERS)).astype(np.float32)
        peak = rng.integers(0, width, FILTERS)
        for t in range(TABLES):
            f[peak, t * DEPTH, np.arange(FILTERS)] += 0.7
        filters.append(f)
    n = FILTERS * len(WIDTHS)
    return Network(tables, filters, np.full(n, -0.3, np.float32), np.concatenate([np.full(2 * n, 0.2), [-2.5]]).astype(np.float32))


def train(network: Network, docs: list[np.ndarray], toxic: np.ndarray, *, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
    """Adam on the logistic loss; gradients flow to the places that won their block's maximum."""
    rng, state, step = np.random.default_rng(seed), {}, 0
    n = FILTERS * len(WIDTHS)

    def update(name, value, gradient, at=slice(None)):
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.98 * v[at] + 0.02 * gradient**2
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.98**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in rows])])
            padded, begin = network.padded(np.concatenate([docs[i] for i in rows]), first)
            e, blocks = network.embed(padded), np.diff(begin)
            found, places = [], []
            for r in network.responses(e):
                places.append(r.argmax(1))
                found.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0])
            before = np.concatenate(found, 1) + network.bias
            hidden = np.maximum(before, 0)
            most = np.maximum.reduceat(hidden, begin[:-1], axis=0)
            pooled = np.concatenate([most, np.add.reduceat(hidden, begin[:-1], axis=0) / blocks[:, None]], 1)
            error = (1 / (1 + np.exp(-(pooled @ network.out[:-1] + network.out[-1]))) - toxic[rows]) / len(rows)
            step += 1
            doc = np.repeat(np.arange(len(rows)), blocks)
            won = hidden == most[doc]
            back = (won * network.out[:n] + network.out[n:-1] / blocks[doc][:, None]) * error[doc][:, None] * (before > 0)
            back = back.astype(np.float32)
            to_words = np.zeros_like(e)
            for k, (width, place) in enumerate(zip(WIDTHS, places, strict=True)):
                g, to_filters = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(network.filters[k])
                for o in range(width):
                    for j in range(FILTERS):
                        live = np.flatnonzero(g[:, j])
                        at = np.minimum(live * BLOCK + place[live, j] + o, len(e) - 1)
                        to_filters[o, :, j] = g[live, j] @ e[at]
                        np.add.at(to_words, at, g[live, j, None] * network.filters[k][o, :, j])
                update(f"f{k}", network.filters[k], to_filters + 1e-4 * network.filters[k])
            update("out", network.out, np.append(error @ pooled, error.sum()).astype(np.float32))
            update("bias", network.bias, back.sum(0))
            moved = np.flatnonzero(np.abs(to_words).sum(1) > 0)
            for t in range(TABLES):
                buckets = padded[moved, t]
                real = buckets < BUCKETS
                ids, inverse = np.unique(buckets[real], return_inverse=True)
                g = np.zeros((len(ids), DEPTH), np.float32)
                np.add.at(g, inverse, to_words[moved][real][:, t * DEPTH : (t + 1) * DEPTH])
                update(f"t{t}", network.tables[t], 0.3 * g, ids)


def best_threshold(logits: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """The logit of best F1, in the middle of the gap it lies in; ``toxic`` and ``other`` weigh the documents of each (distinct) logit."""
    order = np.argsort(-logits, kind="stable")
    s, tp, fp = logits[order], np.cumsum(toxic[order]), np.cumsum(other[order])
    i = int(np.argmax(2 * tp / (tp + fp + tp[-1])))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] - 1)


def fit_arrays(docs: list[np.ndarray], toxic: np.ndarray, model: LanguageModel, *, seed: int = 5) -> tuple[Network | None, np.ndarray]:
    """An uncalibrated network from documents' buckets and labels, None unless both classes are there; and which documents it learned from."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None, np.zeros(len(docs), bool)
    rng = np.random.default_rng(seed)
    part = np.empty(len(docs), np.int64)
    for y in (0, 1):  # 35 % for the tables' start, 40 % for training, the rest is left to calibration
        own = np.flatnonzero(toxic == y)
        part[own] = np.digitize((rng.permutation(len(own)) + 0.5) / len(own), [0.35, 0.75])
    pick = lambda k: ([docs[i] for i in np.flatnonzero(part == k)], toxic[part == k])
    network = _begin(*pick(0), rng)
    train(network, *pick(1), seed=seed)
    network.languages = model
    return network, part < 2


def calibrate(network: Network, found: DataFrame, labels: DataFrame, learned: list[int]) -> None:
    """Moves the logits by ``found`` (doc_id, logit, language) of all labelled documents but held-out and ``learned`` ones.

    Each class weighs as much as all of its labelled documents, those learned from included.  If a class has no other documents,
    those learned from calibrate too.  The driver gets counts by language, class and step of the logit.
    """
    ids = found.sparkSession.createDataFrame([(i,) for i in learned], "doc_id long").withColumn("own", F.lit(True))
    one = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("logit", "language")).alias("f"))  # a repeated id counts once
    step = F.round(F.least(F.greatest("f.logit", F.lit(-LIMIT)), F.lit(LIMIT)) * STEPS).cast("int")
    rows = _marked(labels).join(one, "doc_id").join(F.broadcast(ids), "doc_id", "left").groupBy(F.col("f.language").alias("language"), "toxic", step.alias("step"), F.coalesce("own", F.lit(False)).alias("own")).count().collect()
    total = [sum(r["count"] for r in rows if r.toxic == y) for y in (0, 1)]
    rest = [sum(r["count"] for r in rows if r.toxic == y and not r.own) for y in (0, 1)]
    if min(rest) == 0:
        rest = total
    else:
        rows = [r for r in rows if not r.own]
    if min(rest) == 0:
        return
    middle = np.log(DECISION / (1 - DECISION))

    def shift(own):
        steps = sorted({r.step for r in own})
        weight = np.zeros((2, len(steps)))
        for r in own:
            weight[r.toxic, steps.index(r.step)] += r["count"] * total[r.toxic] / rest[r.toxic]
        return best_threshold(np.array(steps) / STEPS, weight[1], weight[0]) - middle

    network.shift = shift(rows)
    for name in {r.language for r in rows}:
        own = [r for r in rows if r.language == name]
        if all(sum(r["count"] for r in own if r.toxic == y) >= 10 for y in (0, 1)):
            network.language_shift[name] = shift(own)


def _marked(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that aren't held out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, languages: LanguageModel, *, toxic_rows: int = SAMPLE_TOXIC, other_rows: int = SAMPLE_OTHER) -> Network | None:
    """A network learned and calibrated."""
    network, learned = learn(docs, labels, languages, toxic_rows=toxic_rows, other_rows=other_rows)
    if network is not None:
        calibrate(network, logits(docs.where(~held_out(F.col("doc_id"))), network), labels, learned)
    return network


def learn(docs: DataFrame, labels: DataFrame, languages: LanguageModel, *, toxic_rows: int = SAMPLE_TOXIC, other_rows: int = SAMPLE_OTHER) -> tuple[Network | None, list[int]]:
    """An uncalibrated network, and the ids it learned from.

    Learns from at most ``toxic_rows`` and ``other_rows`` labelled documents that aren't held out, in the order of a hash of their ids.

    Executors turn the sampled texts into bucket numbers; the driver gets those.
    """
    spark = docs.sparkSession
    marked = _marked(labels)
    rows = [r for y, n in ((1, toxic_rows), (0, other_rows)) for r in marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not rows:
        return None, []
    label = {r.doc_id: r.toxic for r in rows}
    ids = spark.createDataFrame([(i,) for i in label], "doc_id long")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.string_buffers(batch.column(1))
            for lo, hi, d, o in A.pieces(data, offsets):
                buckets, first = word_buckets(d, o)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "buckets"])

    got = {}  # a repeated id counts once
    for r in sample.mapInArrow(encode, "doc_id long, buckets binary").dropDuplicates(["doc_id"]).toArrow().to_pylist():
        got[r["doc_id"]] = max(got.get(r["doc_id"], b""), r["buckets"])
    order = sorted(got)
    network, own = fit_arrays([np.frombuffer(got[i], np.int32).reshape(-1, TABLES) for i in order], np.array([label[i] for i in order]), languages)
    return network, [i for i, x in zip(order, own, strict=True) if x]


def score(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, language) of every document."""
    return scores(logits(docs, network, id_col=id_col, text_col=text_col), network)


def scores(found: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score, language) from (doc_id, logit, language)."""
    if network is None:
        return found.select("doc_id", F.lit(0.0).alias("score"), "language")
    shift = F.lit(float(network.shift))
    for name, own in network.language_shift.items():
        shift = F.when(F.col("language") == name, F.lit(float(own))).otherwise(shift)
    moved = F.least(F.greatest(F.col("logit") - shift, F.lit(-40.0)), F.lit(40.0))
    return found.select("doc_id", (1 / (1 + F.exp(-moved))).alias("score"), "language")


def logits(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, logit, language) of every document; calibration doesn't change them."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if network is None:
        return chosen.select("doc_id", F.lit(0.0).alias("logit"), F.lit("und").alias("language"))
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of a fixed size, given by BUCKETS and the language model's bound

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            data, offsets = A.string_buffers(batch.column(1))
            for lo, hi, d, o in A.pieces(data, offsets, A.PIECE_BYTES // 2):
                names = [network.languages.predict(t.as_py())[0] for t in batch.column(1).slice(lo, hi - lo)]
                found = network.logits(*word_buckets(d, o))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, pa.float64()), pa.array(names, pa.string())], names=["doc_id", "logit", "language"])

    return chosen.mapInArrow(predict, "doc_id long, logit double, language string")
