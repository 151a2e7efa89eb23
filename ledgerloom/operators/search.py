"""Full text, boxes and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import vectors
from ledgerloom.sources.snapshots import checkpointed

#: Fixed value: what separates terms, everything but letters and digits of any script.
TERM_BREAK = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased terms in order; diacritics stay."""
    return F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, position) of every term; positions from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(terms(F.col(text_col))).alias("position", "term"))


def match_all(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Documents that hold all terms."""
    return index.where(F.col("term").isin(*wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(wanted))).select("doc_id")


def match_any(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return index.where(F.col("term").isin(*wanted)).select("doc_id").distinct()


def match_without(index: DataFrame, wanted: Sequence[str], unwanted: Sequence[str]) -> DataFrame:
    return match_all(index, wanted).join(match_any(index, unwanted), "doc_id", "left_anti")


def match_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.col("term").startswith(prefix)).select("doc_id").distinct()


def match_phrase(index: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """Documents with the terms one after the other: each occurrence names the phrase's start, and one start needs all places."""
    places = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(phrase)))
    hits = index.where(F.col("term").isin(*phrase)).select("doc_id", "position", "term", F.explode(places).alias("p")).where("term = p.term")
    starts = hits.groupBy("doc_id", (F.col("position") - F.col("p.i")).alias("start")).agg(F.count_distinct("p.i").alias("n"))
    return starts.where(F.col("n") == len(phrase)).select("doc_id").distinct()


def match_near(index: DataFrame, a: str, b: str, within: int) -> DataFrame:
    """Documents in which a and b stand at most ``within`` terms apart: the nearest other term by windows, without a join."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    both = index.where(F.col("term").isin(a, b))
    last = lambda t: F.max(F.when(F.col("term") == t, F.col("position"))).over(w)
    gap = F.col("position") - F.when(F.col("term") == a, last(b)).otherwise(last(a))
    return both.withColumn("gap", gap).where(F.col("gap") <= within + 1).select("doc_id").distinct()


def bm25(docs: DataFrame, wanted: Sequence[str], *, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of documents that hold a term; the sum over terms of idf times the saturated frequency.

    Lengths and frequencies are counted within each row, from one split of its text, and stored; only one row of totals is aggregated.
    """
    distinct = list(dict.fromkeys(wanted))
    count_of = lambda t, w: F.size(F.filter(t, lambda x: x == w))
    counts = F.transform(F.array(terms(F.col(text_col))), lambda t: F.struct(F.size(t).alias("len"), *(count_of(t, w).alias(f"tf{i}") for i, w in enumerate(distinct))))
    counted = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.explode(counts).alias("c")).select("doc_id", "c.*").where("len > 0"))
    n_terms = len(distinct)
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(n_terms)))
    held = F.lit(False)
    score = F.lit(0.0)
    for i in range(n_terms):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        held = held | (f > 0)
        score = score + F.log1p((F.col("n") - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return counted.where(held).crossJoin(F.broadcast(totals)).select("doc_id", score.alias("score"))  # one row of totals


def highlight(text: Column, wanted: Sequence[str], before: str = "[", after: str = "]") -> Column:
    """The text with each wanted term between marks."""
    pattern = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(wanted) + ")(?![\\p{L}\\p{N}])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def snippet(text: Column, wanted: Sequence[str], size: int = 10) -> Column:
    """``size`` terms from the first wanted one on, joined by spaces."""
    found = terms(text)
    at = F.array_min(F.filter(F.array(*(F.array_position(found, t) for t in wanted)), lambda p: p > 0))
    return F.array_join(F.slice(found, F.coalesce(at, F.lit(1)).cast("int"), size), " ")


def overlaps(a: DataFrame, b: DataFrame, a_box: Sequence[tuple[str, str]], b_box: Sequence[tuple[str, str]], cell: float) -> DataFrame:
    """Pairs of boxes that meet in every dimension, borders included.

    Both sides are dealt into cells of the first dimension, an equi-join; a pair counts in the cell where its overlap begins, so none counts twice.
    """
    lo, hi = a_box[0]
    blo, bhi = b_box[0]
    cells = lambda df, x, y: df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(x) / cell), F.floor(F.col(y) / cell))))
    joined = cells(a, lo, hi).join(cells(b, blo, bhi), "__cell").where(F.col("__cell") == F.floor(F.greatest(lo, blo) / cell))
    for (x, y), (u, v) in zip(a_box, b_box, strict=True):
        joined = joined.where((F.col(x) <= F.col(v)) & (F.col(u) <= F.col(y)))
    return joined.drop("__cell")


def nearest(vectors_: DataFrame, query: Sequence[float], k: int, *, distance=vectors.l2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest rows, ties by id: a top-k of each partition, then of those."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors_.select(id_col, distance(F.col(vector_col), q).alias("distance")).orderBy("distance", id_col).limit(k)


#: Numbers of a block of distances, and bytes of the stated queries that may be told to all tasks.
BLOCK_NUMBERS, QUERY_BYTES = 1 << 21, 64 << 20


def _squared(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def nearest_of_each(queries: DataFrame, vectors_: DataFrame, k: int, *, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", most_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) for a stated set of queries (query_id, q) against all rows; ties by id.

    The queries go to all tasks as one matrix, which is refused beyond ``most_bytes``.  Each task multiplies blocks of its rows with it and keeps
    the k nearest rows of each query, so only k rows of each query and task are shuffled.  ``metric``: l2 or cosine; rows without a vector
    or of another length are nobody's neighbours, nor are rows of length 0 in cosine.
    """
    size = queries.agg(F.coalesce(F.sum(F.size("q").cast("long") * 8 + 8), F.lit(0)).alias("b")).head().b
    if size > most_bytes:
        raise ValueError(f"too_large: queries of {size} bytes")
    stated = queries.where("q IS NOT NULL").orderBy("query_id").collect()  # most_bytes at most
    ids = np.array([r.query_id for r in stated], np.int64)
    matrix = np.array([r.q for r in stated], np.float64).reshape(len(stated), -1)
    if metric == "cosine":
        fine = _squared(matrix) > 0
        ids, matrix = ids[fine], matrix[fine] / np.sqrt(_squared(matrix[fine]))[:, None]
    shared = vectors_.sparkSession.sparkContext.broadcast((ids, matrix))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        if not len(q):
            return
        width, norm = q.shape[1], _squared(q)
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            lists = batch.column(1)
            of, length = batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            fit = np.flatnonzero((length == width) & ~lists.is_null().to_numpy(zero_copy_only=False))
            rows = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), width)
            of = of[fit]
            if metric == "cosine":
                fine = _squared(rows) > 0
                of, rows = of[fine], rows[fine] / np.sqrt(_squared(rows[fine]))[:, None]
            step = max(1, BLOCK_NUMBERS // len(q))
            for lo in range(0, len(of), step):
                part, own = rows[lo : lo + step], of[lo : lo + step]
                near = norm[:, None] + _squared(part)[None, :] - 2 * (q @ part.T)
                # What a block of products can't tell apart is measured again, number by number.
                bound = np.minimum(best_d[:, -1] ** 2, np.partition(near, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1] if len(own) >= k else np.inf)
                at_q, at_r = np.nonzero(near <= (bound + 1e-9 * (1 + norm + _squared(part).max(initial=0)))[:, None])
                exact = np.sqrt(_squared(q[at_q] - part[at_r]))
                every_q, every_d, every_i = np.concatenate([np.repeat(np.arange(len(q)), k), at_q]), np.concatenate([best_d.ravel(), exact]), np.concatenate([best_i.ravel(), own[at_r]])
                order = np.lexsort((every_i, every_d, every_q))
                first = np.searchsorted(every_q[order], np.arange(len(q)))
                kept = order[first[:, None] + np.arange(k)[None, :]]
                best_d, best_i = every_d[kept], every_i[kept]
        there = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)[there.ravel()]), pa.array(best_i[there]), pa.array(best_d[there])], names=["query_id", "id", "distance"])

    given = vectors_.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    some = given.mapInArrow(local, "query_id long, id long, distance double")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    distance = F.col("distance") if metric == "l2" else F.col("distance") * F.col("distance") / 2
    return ranked.select("query_id", "id", distance.alias("distance"), "rank")
