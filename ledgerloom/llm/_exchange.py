"""Columnar exchange: what a batch has for a bucket travels as one compressed blob, not as rows.

Fingerprints of all words or bytes of a corpus are many small records.  Moved as rows each costs an object and tens of
bytes in every shuffle; packed, a batch's records for one bucket are one binary value whose columns
are split into byte planes and compressed.  Every reducer then works on whole arrays.  A worker holds one bucket at a time; there are as
many as spark.sql.shuffle.partitions, and more where the input's files would else give a bucket over ``BUCKET_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import _arrays as A
from ledgerloom.llm._spark import LAST_ID, shuffle_partitions

BLOBS = "bucket int, kind int, blob binary"
#: Bits of a filter of documents, and of its blocks.
DOC_BITS, DOC_BLOCK = 1 << 25, 1 << 20
#: Documents that are compressed together, in bytes; bytes of files for a bucket, buckets at most, and from where on a plan's size is only a guess.
TEXT_BYTES, BUCKET_BYTES, MOST_BUCKETS, UNKNOWN_BYTES = 8 << 20, 128 << 20, 1 << 20, 1 << 55
#: Rows that a task gathers for each bucket before it sends them, and for all buckets at most.
BUCKET_ROWS, TASK_ROWS = 1 << 10, 1 << 19


def bucket_count(docs: DataFrame) -> int:
    """Buckets for documents: by the size of their files, which the plan knows without reading them, and at least one for each shuffle partition."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-known // BUCKET_BYTES) if known < UNKNOWN_BYTES else 1
    return max(shuffle_partitions(docs.sparkSession), min(by_size, MOST_BUCKETS))


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Arrays of one length, as byte planes, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(n).tobytes(), *planes]))


def unpack(blob: bytes, kinds: Sequence) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def gather(blobs: Iterable[bytes], kinds: Sequence) -> list[np.ndarray]:
    """The arrays of many blobs, one after the other."""
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def scatter(bucket: np.ndarray, columns: Sequence[np.ndarray], kind: int = 0) -> pa.RecordBatch:
    """One row for each bucket that occurs."""
    small = len(bucket) and bucket.max() < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")  # a radix sort where 16 bits do
    sorted_ = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(bucket)) if len(edge) else edge
    columns = [c[order] for c in columns]
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(edge, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(sorted_[edge], pa.int32()), pa.array(np.full(len(edge), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def pack_texts(columns: Sequence[np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Arrays of one length and a text for each of their rows, compressed together."""
    n = len(starts)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in (*columns, lengths.astype(np.int32))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(n).tobytes(), *planes, span_bytes(data, starts, lengths)]))


def unpack_texts(blob: bytes, kinds: Sequence) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns, bytes, offsets) of a blob of ``pack_texts``."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (*kinds, np.int32):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out[:-1], np.frombuffer(raw, np.uint8, offset=at), np.concatenate([[0], np.cumsum(out[-1], dtype=np.int64)])


def span_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], ..., starts[i] + lengths[i] - 1 for all i."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def span_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of all spans, one after the other."""
    view = memoryview(np.ascontiguousarray(data))
    return b"".join([view[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)])


def span_data(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all spans, one after the other."""
    return np.frombuffer(span_bytes(data, starts, lengths), np.uint8), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def scatter_texts(bucket: np.ndarray, columns: Sequence[np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One row for each bucket that occurs, with texts."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    blobs = [pack_texts([c[own] for c in columns], data, starts[own], lengths[own]) for own in np.split(order, edge[1:])] if len(bucket) else []
    return pa.RecordBatch.from_arrays([pa.array(sorted_[edge], pa.int32()), pa.array(np.full(len(edge), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


class Gathered:
    """Texts for buckets, from many small pieces of work, sent together when they are ``TEXT_BYTES`` or all there is."""

    def __init__(self, kind: int = 0):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, bucket: np.ndarray, columns: Sequence[np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket, columns, span_bytes(data, starts, lengths), lengths))
        self.size += int(lengths.sum()) + 32 * len(lengths)
        if self.size >= TEXT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        parts, self.parts, self.size = self.parts, [], 0
        lengths = np.concatenate([p[3] for p in parts])
        columns = [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        yield scatter_texts(np.concatenate([p[0] for p in parts]), columns, data, np.cumsum(lengths) - lengths, lengths, self.kind)


class Dealt:
    """Rows for buckets, from many pieces, sent together: as many buckets as a large input has would else get a blob of a few rows from every piece."""

    def __init__(self, n: int, kind: int = 0):
        self.limit, self.kind, self.parts, self.size = min(n * BUCKET_ROWS, TASK_ROWS), kind, [], 0

    def add(self, bucket: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket, *columns))
        self.size += len(bucket)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        parts, self.parts, self.size = self.parts, [], 0
        bucket, *columns = parts[0] if len(parts) == 1 else (np.concatenate(c) for c in zip(*parts, strict=True))
        yield scatter(bucket, columns, self.kind)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rest: bool = False) -> DataFrame:
    """(doc_id, tie, text): doc_id with LAST_ID for null; tie tells rows of one doc_id apart, by their texts' order.

    Ids are counted first, over the id column alone; only where one repeats does a window number its rows.  With
    ``rest`` a struct of all columns comes along, whatever their names.
    """
    chosen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("rest")] if rest else []))
    if chosen.groupBy("doc_id").count().where("count > 1").limit(1).count():
        tie = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"))).cast("long")
    else:
        tie = F.lit(0).cast("long")
    return chosen.select("doc_id", tie.alias("tie"), "text", *(["rest"] if rest else []))


def document_bucket(doc_id: np.ndarray, n: int) -> np.ndarray:
    return (A.mix(doc_id.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def over_pieces(docs: DataFrame, work: Callable[..., Iterable[pa.RecordBatch]], schema: str, limit: int = A.PIECE_BYTES, *, gathers: bool = False) -> DataFrame:
    """work(doc_ids, ties, data, offsets) on the pieces of each batch of ``numbered`` documents.

    If it ``gathers``, work() gives for each task what takes the pieces, and what to do after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell, *last = work() if gathers else (work,)
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = A.string_buffers(batch.column(2))
            for lo, hi, d, o in A.pieces(data, offsets, limit):
                yield from tell(ids[lo:hi], ties[lo:hi], d, o)
            A.release()
        for finish in last:
            yield from finish()

    return docs.select("doc_id", "tie", "text").mapInArrow(run, schema)


TEXT = 99  # the kind of blobs that hold documents


class Marked:
    """Which documents something is about: two bits of DOC_BITS for each (doc_id, tie), whatever their number; a full filter marks more, never fewer."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = A.join2(ids.astype(np.uint64), ties.astype(np.uint64))
        return tuple((x % np.uint64(DOC_BITS)).astype(np.int64) for x in (key, key >> np.uint64(32)))

    def has(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for at in self.places(ids, ties):
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        return ok


def marked(blobs: DataFrame, kind: int, kinds: Sequence):
    """A broadcast Marked of the documents that blobs of a kind are about; their first two columns are doc_id and tie."""

    def mark(batches):
        bits = np.zeros(DOC_BITS, bool)
        for batch in batches:
            for blob in batch.column(0):
                ids, ties = unpack(blob.as_py(), kinds)[:2]
                for at in Marked.places(ids, ties):
                    bits[at] = True
        parts = np.packbits(bits).reshape(-1, DOC_BLOCK // 8)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.zeros(len(full)), pa.int32()), pa.array([pack([parts[i]]) for i in full], pa.binary())], names=["bucket", "kind", "blob"])
        del bits
        A.release()

    def merge(key, found):
        bits = np.bitwise_or.reduce([unpack(b, [np.uint8])[0] for b in found[0]])
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([0], pa.int32()), pa.array([pack([bits])], pa.binary())], names=["bucket", "kind", "blob"])

    context = blobs.sparkSession.sparkContext
    few = blobs.where(f"kind = {kind}").select("blob").coalesce(2 * context.defaultParallelism)
    out = np.zeros((DOC_BITS // DOC_BLOCK, DOC_BLOCK // 8), np.uint8)
    for r in by_bucket(few.mapInArrow(mark, BLOBS), merge, BLOBS).collect():  # a row for each block
        out[r.bucket] = unpack(bytes(r.blob), [np.uint8])[0]
    return context.broadcast(Marked(out.reshape(-1)))  # DOC_BITS / 8 bytes


def packed_texts(docs: DataFrame, n: int, only=None) -> DataFrame:
    """Documents, all or those that ``only`` marks, as compressed blobs by document bucket."""

    def run(ids, ties, data, offsets):
        kept = np.arange(len(ids)) if only is None else np.flatnonzero(only.value.has(ids, ties))
        if not len(kept):
            return
        bucket = document_bucket(ids[kept], n)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
        rows = []
        for part in np.split(order, edges[1:]):
            own = kept[part]
            length = offsets[own + 1] - offsets[own]
            head = np.concatenate([[len(own)], ids[own], ties[own], length]).astype(np.int64)
            rows.append((int(bucket[part[0]]), TEXT, zstandard.ZstdCompressor(level=3).compress(head.tobytes() + span_bytes(data, offsets[own], length))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    return over_pieces(docs, run, BLOBS, TEXT_BYTES)


def unpacked_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ties, data, offsets) of a blob of ``packed_texts``."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, ties, length = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    return ids, ties, np.frombuffer(raw, np.uint8, offset=8 * (3 * n + 1)), np.concatenate([[0], np.cumsum(length)])


def by_bucket(blobs: DataFrame, work: Callable[[dict[int, list[bytes]]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """work({kind: blobs}) on every bucket."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                found.setdefault(kind, []).append(blob)
        yield from work(int(key[0].as_py()), found)
        found.clear()
        A.release()

    return blobs.groupBy("bucket").applyInArrow(run, schema)


def with_documents(docs: DataFrame, n: int, sides: Sequence[DataFrame], work: Callable, schema: str, only=None, rest: Callable[..., Iterable[pa.RecordBatch]] | None = None) -> DataFrame:
    """work(bucket, side blobs by kind) gives what takes (doc_ids, ties, data, offsets) of every text blob of the bucket, and what to do after the last.

    ``docs`` are ``numbered``; the sides are BLOBS whose bucket is that of the document that they are about.  Only the documents that ``only``
    marks are moved; if ``rest`` is given, rest(doc_ids, ties, data, offsets) takes the others where they are.
    """

    def run(key: int, found: dict[int, list[bytes]]):
        texts = found.pop(TEXT, [])
        tell, *last = work(key, found)
        for blob in texts:
            yield from tell(*unpacked_texts(blob))
        for finish in last:
            yield from finish()

    def stay(ids, ties, data, offsets):
        others = np.flatnonzero(~only.value.has(ids, ties))
        if len(others):
            yield from rest(ids[others], ties[others], *span_data(data, offsets[others], offsets[others + 1] - offsets[others]))

    every = packed_texts(docs, n, only)
    for side in sides:
        every = every.unionByName(side)
    out = by_bucket(every, run, schema)
    return out if rest is None else out.unionByName(over_pieces(docs, stay, schema))
