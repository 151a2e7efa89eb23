"""Substring dedup (op 2): a de Bruijn graph of token k-mers, compacted, with source coordinates.

The edges are the runs of ``K`` = 20 words.  As in minimizer-bucketed compaction, runs of edges that stand together are compacted before any
edge is spelled out: a super-k-mer (``_superkmers``) is a piece of a path, and its earliest occurrence is the source of its edges.  Pieces
that may share edges with other pieces are spelled out as edges with 128 bits of hash.  Equal edges are grouped, their
smallest coordinates are their source, and each other occurrence is joined with it; joins with the degrees of their
nodes (the 19-word overlaps) tell where paths branch, and a join of each occurrence with the one before it, in the document and at the source, where its
repeated path begins.  Pieces and spelled paths are then compacted document by document into maximal paths, each with the coordinates of its source.

Every path is verified: the words at its source are read from the source document and compared with the path's own.  Only windows
whose 20 words are equal are removed.

Defined results: windows are judged on the input; null and empty texts have no words; very long texts are read whole, in overlapping
parts; rows of one doc_id are ordered by their texts, and the earlier counts as earlier, so of repeated rows the first keeps its words; a null
doc_id is the last one; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import _arrays as A
from ledgerloom.llm import _exchange as X
from ledgerloom.llm import _superkmers as K
from ledgerloom.llm._spark import LAST_ID, cut

WINDOW, GRAM = 20, 8
_EDGE = "e0 long, e1 long, tail long, head long, doc long, tie long, pos long"


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = A.words(data, offsets)
    return A.span_hashes(data, starts, ends), first


def open_edges(docs: DataFrame, records: DataFrame, k: int, n: int) -> DataFrame:
    """The edges of the open super-k-mers' earliest occurrences, with their end nodes."""

    def work(_, sides):
        side = K.Side(sides.get(K.OPENS, []), K.OPEN)

        def tell(ids, ties, data, offsets):
            doc, (start, count, _) = side.together(ids, ties)
            if not len(doc):
                return
            used = np.unique(doc)
            length = offsets[used + 1] - offsets[used]
            h, first = word_units(*X.span_data(data, offsets[used], length))
            place = np.searchsorted(used, doc)
            at = K.ranges(first[place] + start, count)
            owner = np.repeat(doc, count)
            e0, node = A.window_hashes(h, k), A.window_hashes(h, k - 1)
            e1 = A.window_hashes(A.mix(h + np.uint64(77)), k)
            as_long = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([as_long(e0[at]), as_long(e1[at]), as_long(node[at]), as_long(node[at + 1]), pa.array(ids[owner]), pa.array(ties[owner]), pa.array(at - first[np.searchsorted(used, owner)])], names=[c.split()[0] for c in _EDGE.split(", ")])

        return (tell,)

    return X.with_documents(docs, n, [records.where(f"kind = {K.OPENS}")], work, _EDGE, X.marked(records, K.OPENS, K.OPEN))


_PATH = ("doc", "tie", "start", "edges", "src_doc", "src_tie", "src_start")


def repeated_paths(edges: DataFrame) -> DataFrame:
    """Compacted paths (doc, tie, start, edges, src_doc, src_tie, src_start) of the edges that an earlier edge equals.

    A path begins where the edge before isn't repeated, where its source goes on elsewhere, and where its node branches.
    """
    edges = cut(edges)
    key = ["e0", "e1"]
    sources = edges.groupBy(*key).agg(F.min(F.struct("doc", "tie", "pos")).alias("source"), F.count("*").alias("n"), F.first("tail").alias("tail"), F.first("head").alias("head")).where("n > 1")
    graph = cut(sources.select(*key, "source", "tail", "head"))
    into = graph.groupBy(F.col("head").alias("tail")).agg(F.count("*").alias("n_in"))
    out_of = graph.groupBy("tail").agg(F.count("*").alias("n_out"))
    branching = into.join(out_of, "tail").where((F.col("n_in") > 1) | (F.col("n_out") > 1)).select("tail", F.lit(True).alias("branch"))
    again = edges.join(graph.select(*key, "source"), key).where(F.struct("doc", "tie", "pos") != F.col("source"))
    again = cut(again.join(branching, "tail", "left").select("doc", "tie", "pos", F.col("source.doc").alias("src_doc"), F.col("source.tie").alias("src_tie"), F.col("source.pos").alias("src_pos"), F.coalesce("branch", F.lit(False)).alias("branch")))
    # The edge before: the one that ends where this one begins, in the document and at the source.
    step = again.select("doc", "tie", (F.col("pos") + 1).alias("pos"), "src_doc", "src_tie", (F.col("src_pos") + 1).alias("src_pos"), F.lit(True).alias("goes_on"))
    linked = again.join(step, ["doc", "tie", "pos", "src_doc", "src_tie", "src_pos"], "left").withColumn("begins", F.col("branch") | F.col("goes_on").isNull())
    order = Window.partitionBy("doc", "tie", "src_doc", "src_tie", F.col("src_pos") - F.col("pos")).orderBy("pos")
    numbered = linked.withColumn("shift", F.col("src_pos") - F.col("pos")).withColumn("path", F.sum(F.col("begins").cast("int")).over(order))
    found = numbered.groupBy("doc", "tie", "src_doc", "src_tie", "shift", "path").agg(F.min("pos").alias("start"), F.count("*").alias("edges"))
    return found.withColumn("src_start", F.col("start") + F.col("shift")).select(*_PATH)


def _kept_bytes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Of each document its kept words, joined by single spaces."""
    step = np.zeros(len(data) + 2, np.int8)
    s, e = starts[kept], ends[kept]
    step[s] += 1
    step[e + 1] -= 1  # with one byte after the word
    taken = np.cumsum(step[:-2]) > 0
    out = np.where(A.SPACE[data], np.uint8(32), data)
    return [out[a:b][taken[a:b]].tobytes().removesuffix(b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _path_blobs(paths: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield K.repeat_blobs([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(_PATH))], n)

    return paths.select(*_PATH).mapInArrow(run, X.BLOBS)


def removals(docs: DataFrame, paths: DataFrame, answers: DataFrame, k: int, n: int, *, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if asked for, the kept text of every ``numbered`` document."""

    def report(ids, ties, data, offsets, doc, start, count):
        # A kept word may touch the next document: a word ends at its document's end.
        padded = np.insert(data, offsets[1:], 32)
        offsets = offsets + np.arange(len(offsets))
        starts, ends, first = A.words(padded, offsets)
        again = np.zeros(len(starts) + 1, bool)
        again[K.ranges(first[doc] + start, count)] = True
        removed = A.cover(len(starts), np.flatnonzero(again[:-1]), k)
        texts = _kept_bytes(padded, offsets, starts, ends, ~removed)
        columns = [pa.array(ids, mask=ids == LAST_ID), pa.array(np.diff(first)), pa.array(A.segment_sums(removed, first)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            columns.append(pa.array([t.decode("utf-8", "replace") for t in texts]))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    def work(_, sides):
        sources = K.Sources(sides, K.WordBounds())
        return (lambda *piece: report(*piece, *sources.verified(*piece, k)),)

    none = np.zeros(0, np.int64)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return X.with_documents(docs, n, [paths.where(f"kind = {K.REPEATS}"), answers], work, schema, X.marked(paths, K.REPEATS, K.REPEAT), lambda *piece: report(*piece, none, none, none))


def dedup(docs: DataFrame, *, k: int = WINDOW, m: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Removes from every document the words that repeated windows cover."""
    numbered = X.numbered(docs)
    n = X.bucket_count(docs)
    records = cut(K.records(numbered, word_units, k, m, n, across=False))
    spelled = _path_blobs(repeated_paths(open_edges(numbered, records, k, n)), n)
    paths = cut(K.paths(records.unionByName(spelled), k, n))
    return removals(numbered, paths, K.answers(numbered, paths, K.WordBounds(), n), k, n, keep_text=keep_text)
