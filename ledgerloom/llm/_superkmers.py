"""Windows that have occurred before, found by minimizers and verified at their sources.

Every window of k units (words or bytes) has a minimizer, the run of m units with the smallest hash in it; consecutive
windows with one minimizer form a super-k-mer, of about half as many windows as a window has runs.  Equal windows have
equal minimizers, so all that can decide about a window meets in its minimizer's bucket, and a record for each
super-k-mer is enough there: of equal contents the earliest is the source and the others repeat it.  Different contents of one
minimizer may still share windows.  A window has half of the units beside its minimizer on its left or on its right, so
two contents that share one agree in the flank of that length on one side; super-k-mers that agree in a flank with
another content are called open, and only their windows must be compared one by one.

Hashes only say where to look.  Repeats whose places and sources follow one another are compacted into paths; each document asks for the units
under its paths' sources, reads them, and compares them with its own.  Only windows whose units are all equal count as repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import _arrays as A
from ledgerloom.llm import _exchange as X

#: Units of one document that are looked at together; a longer document is cut with an overlap of k - 1.
CHUNK = 4 << 20

#: Minimizer (40 bits), content (56 bits), left and right flank (16 bits, 0: none), doc_id, tie, start, windows.
_RECORD = (np.uint64, np.uint64, np.uint16, np.uint16, np.int64, np.int64, np.int64, np.int32)
#: A repeat: doc_id, tie, start, windows, and doc_id, tie and start of its source, which is earlier.
REPEAT = (np.int64, np.int64, np.int64, np.int32, np.int64, np.int64, np.int64)
#: A first occurrence whose windows must be compared: doc_id, tie, start, windows, bucket.
OPEN = (np.int64, np.int64, np.int64, np.int32, np.int32)
#: Units that a bucket asks for: doc_id, tie, first and end unit, the asking bucket; and what it gets: doc_id, tie, first unit, and the text.
ASK, ANSWER = (np.int64, np.int64, np.int64, np.int64, np.int32), (np.int64, np.int64, np.int64)
REPEATS, OPENS, ASKS, ANSWERS = 1, 2, 3, 4  # kinds of blobs beside a document


def super_kmers(h: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, number of windows, minimizer, content, left flank, right flank) of the super-k-mers of documents of unit hashes."""
    n, w = len(h), k - m + 1
    if n < k:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.uint16) for _ in range(2)))
    if n > 2 * CHUNK:
        parts = []
        for i in range(len(first) - 1):
            for lo in range(int(first[i]), int(first[i + 1]), CHUNK):
                own = h[lo : min(lo + CHUNK + k - 1, int(first[i + 1]))]
                found = super_kmers(own, np.array([0, len(own)]), k, m)
                parts.append((found[0] + i, found[1] + lo - first[i], *found[2:]))
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True))
    hashes = A.WindowHashes(h)
    grams = hashes.every(m)
    bits = np.uint64(max(1, int(len(grams) - 1).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (A.sliding_min(key, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    if not len(at):
        return super_kmers(h[:0], first[:1], k, m)
    a = anchor[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start, a = at[begin], a[begin]
    content = A.join2(A.join2(hashes.at(k, start), hashes.at(k, start + count - 1)), (count * 65536 + (a - start)).astype(np.uint64))
    half = (k - m + 1) // 2
    short = lambda at, there: np.where(there, (hashes.at(half, np.clip(at, 0, n - half)) >> np.uint64(48)) | np.uint64(1), np.uint64(0)).astype(np.uint16)
    left, right = short(a - half, start <= a - half), short(a + m, start + count - 1 + k >= a + m + half)
    return doc[start], start - first[doc[start]], count, grams[a] >> np.uint64(24), content >> np.uint64(8), left, right


def _leaders(order_keys: list[np.ndarray], gram: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by gram, content and coordinates; where a new content begins; where a new gram begins)."""
    ids, _, start = order_keys
    ascending = len(ids) < 2 or bool(((ids[1:] > ids[:-1]) | ((ids[1:] == ids[:-1]) & (start[1:] > start[:-1]))).all())
    order = np.arange(len(ids)) if ascending else np.lexsort(order_keys[::-1])
    both = A.join2(gram, content)
    order = order[A.stable_order(both[order])]
    g, c = gram[order], content[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    new = new_gram.copy()
    new[1:] |= c[1:] != c[:-1]
    return order, new, new_gram


def chain(doc, tie, start, count, src_doc, src_tie, src_start) -> list[np.ndarray]:
    """The same repeats, those that follow one another in the document and at the source as one."""
    shift = src_start - start
    order = np.lexsort((start, shift, src_tie, src_doc, tie, doc))
    columns = [c[order] for c in (doc, tie, src_doc, src_tie, shift)]
    start, end = start[order], start[order] + count[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = start[1:] > end[:-1]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return [np.zeros(0, k) for k in REPEAT]
    doc, tie, src_doc, src_tie, shift = (c[at] for c in columns)
    start, end = start[at], np.maximum.reduceat(end, at)
    return [doc, tie, start, (end - start).astype(np.int32), src_doc, src_tie, start + shift]


def repeat_blobs(repeats: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Chained repeats as blobs by document bucket."""
    chained = chain(*repeats)
    return X.scatter(X.document_bucket(chained[0], n), chained, REPEATS)


def records(docs: DataFrame, units, k: int, m: int, n: int, *, across: bool, limit: int = A.PIECE_BYTES) -> DataFrame:
    """Blobs, by document bucket, of the super-k-mers that repeat an earlier one, and of the open ones among the others.

    ``units(data, offsets)`` gives unit hashes and the first unit of each document.  ``across``: only smaller doc_ids are
    earlier; else also smaller places of the same document.  Within a piece repetitions go with their source in
    the piece, so that a very frequent content sends one record from each piece.
    """

    def settled(order, new, ids):
        """(leader of each row in order, whether the row repeats it)."""
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return lead, ids[order] != ids[lead] if across else ~new

    def sender():
        firsts, again = X.Dealt(n), X.Dealt(n, REPEATS)

        def send(ids, ties, data, offsets):
            h, first = units(data, offsets)
            doc, start, count, gram, content, left, right = super_kmers(h, first, k, m)
            if not len(doc):
                return
            own, tie = ids[doc], ties[doc]
            order, new, _ = _leaders([own, tie, start], gram, content)
            lead, later = settled(order, new, own)
            rows = np.sort(order[~later])
            bucket = (A.mix(gram[rows]) % np.uint64(n)).astype(np.int32)
            yield from firsts.add(bucket, [c[rows] for c in (gram, content, left, right, own, tie, start, count.astype(np.int32))])
            if later.any():
                i, j = order[later], lead[later]
                chained = chain(own[i], tie[i], start[i], count[i], own[j], tie[j], start[j])
                yield from again.add(X.document_bucket(chained[0], n), chained)

        return send, firsts.flush, again.flush

    def settle(bucket, found):
        if kept := found.get(REPEATS):  # they only pass by, on their way to this bucket's documents
            yield repeat_blobs(X.gather(kept, REPEAT), n)
        if not found.get(0):
            return
        gram, content, left, right, own, tie, start, count = X.gather(found.pop(0), _RECORD)
        order, new, _ = _leaders([own, tie, start], gram, content)
        leaders = order[new]
        open_ = np.zeros(len(leaders), bool)
        for flank in (left, right):
            side = np.flatnonzero(flank[leaders] > 0)
            _, back, size = np.unique(A.join2(gram[leaders[side]], flank[leaders[side]].astype(np.uint64)), return_inverse=True, return_counts=True)
            open_[side] |= size[back] > 1
        lead, later = settled(order, new, own)
        if later.any():
            i, j = order[later], lead[later]
            yield repeat_blobs([own[i], tie[i], start[i], count[i], own[j], tie[j], start[j]], n)
        rows = order[~later & open_[np.cumsum(new) - 1]]
        rows = rows[np.lexsort((start[rows], tie[rows], own[rows]))]
        if len(rows):
            yield X.scatter(X.document_bucket(own[rows], n), [own[rows], tie[rows], start[rows], count[rows], np.full(len(rows), bucket, np.int32)], OPENS)

    return X.by_bucket(X.over_pieces(docs, sender, X.BLOBS, limit, gathers=True), settle, X.BLOBS)


def paths(repeats: DataFrame, k: int, n: int) -> DataFrame:
    """Blobs of the repeats of all sources of records, compacted into paths, by document bucket, and of what their documents ask for, by the source's bucket."""

    def compact(bucket, found):
        blobs = found.get(REPEATS, [])
        if not blobs:
            return
        chained = chain(*X.gather(blobs, REPEAT))
        yield X.scatter(np.full(len(chained[0]), bucket, np.int32), chained, REPEATS)
        _, _, _, count, doc, tie, lo = chained
        order = np.lexsort((lo, tie, doc))
        doc, tie, lo, hi = doc[order], tie[order], lo[order], (lo + count + k - 1)[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
        group = np.cumsum(new)
        reached = np.maximum.accumulate(hi + (group << 40)) - (group << 40)
        new[1:] |= lo[1:] > reached[:-1]
        at = np.flatnonzero(new)
        doc, tie, lo, hi = doc[at], tie[at], lo[at], np.maximum.reduceat(hi, at)
        yield X.scatter(X.document_bucket(doc, n), [doc, tie, lo, hi, np.full(len(at), bucket, np.int32)], ASKS)

    return X.by_bucket(repeats.where(f"kind = {REPEATS}"), compact, X.BLOBS)


def answers(docs: DataFrame, asked: DataFrame, bounds, n: int) -> DataFrame:
    """Blobs, by asking bucket, of the texts under the asked units.

    ``bounds(data, offsets, doc, lo, hi)`` gives the bytes at which runs of units of documents begin and end.
    """

    def work(_, sides):
        side, out = Side(sides.get(ASKS, []), ASK), X.Gathered(ANSWERS)

        def tell(ids, ties, data, offsets):
            doc, (lo, hi, bucket) = side.together(ids, ties)
            if len(doc):
                a, b = bounds(data, offsets, doc, lo, hi)
                yield from out.add(bucket, [ids[doc], ties[doc], lo], data, a, b - a)

        return tell, out.flush

    return X.with_documents(docs, n, [asked.where(f"kind = {ASKS}")], work, X.BLOBS, X.marked(asked, ASKS, ASK))


class Sources:
    """The paths of a bucket's documents, and the texts that they are to be compared with."""

    def __init__(self, sides: dict[int, list[bytes]], bounds):
        self.side, self.bounds = Side(sides.get(REPEATS, []), REPEAT), bounds
        parts = [X.unpack_texts(b, ANSWER) for b in sides.pop(ANSWERS, [])]
        columns = [np.concatenate([p[0][i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        self.data = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]) if parts else np.zeros(1, np.int64)
        self.order = np.lexsort(columns[::-1])
        self.key = np.rec.fromarrays([c[self.order] for c in columns], names="doc,tie,lo")

    def verified(self, ids, ties, data, offsets, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, windows) of the runs of windows that are equal to their sources."""
        doc, (start, count, src_doc, src_tie, src_start) = self.side.together(ids, ties)
        if not len(doc):
            return doc, start, count
        at = np.searchsorted(self.key, np.rec.fromarrays([src_doc, src_tie, src_start], names="doc,tie,lo"), "right") - 1
        source = self.order[at]
        size = count + k - 1
        from_ = src_start - self.key["lo"][at]
        a, b = self.bounds(data, offsets, doc, start, start + size)
        c, d = self.bounds(self.data, self.offsets, source, from_, from_ + size)
        out = []
        for i in range(len(doc)):
            own, other = data[a[i] : b[i]].tobytes(), self.data[c[i] : d[i]].tobytes()
            if own == other:
                out.append((doc[i], start[i], count[i]))
                continue
            same = self.bounds.compare(own, other)  # unit by unit: as texts they differ
            begin, length = runs(same)
            out += [(doc[i], start[i] + s, n - k + 1) for s, n in zip(begin.tolist(), length.tolist(), strict=True) if n >= k]
        return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (doc[:0], start[:0], count[:0])


class WordBounds:
    """Where runs of words begin and end."""

    def __call__(self, data, offsets, doc, lo, hi):
        used = np.unique(doc)
        length = offsets[used + 1] - offsets[used]
        starts, ends, first = A.words(*X.span_data(data, offsets[used], length))
        at = np.searchsorted(used, doc)
        move = offsets[used] - np.concatenate([[0], np.cumsum(length)[:-1]])  # from places in the used documents to places in all
        return starts[first[at] + lo] + move[at], ends[first[at] + hi - 1] + move[at]

    @staticmethod
    def compare(a: bytes, b: bytes) -> np.ndarray:
        return np.array([x == y for x, y in zip(a.split(), b.split(), strict=False)], bool)


class ByteBounds:
    """Where runs of bytes begin and end."""

    def __call__(self, data, offsets, doc, lo, hi):
        return offsets[doc] + lo, offsets[doc] + hi

    @staticmethod
    def compare(a: bytes, b: bytes) -> np.ndarray:
        n = min(len(a), len(b))
        return np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)


class Side:
    """Records of a document bucket, to be read document by document."""

    def __init__(self, blobs: list[bytes], kinds):
        self.columns = X.gather(blobs, kinds)
        order = np.lexsort(self.columns[:2][::-1])
        self.columns = [c[order] for c in self.columns]
        ids, ties = self.columns[:2]
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(ids)) if len(new) else new
        self.rows = {(int(ids[a]), int(ties[a])): (int(a), int(b)) for a, b in zip(new, ends, strict=True)}

    def of(self, doc_id: int, tie: int) -> list[np.ndarray]:
        a, b = self.rows.get((int(doc_id), int(tie)), (0, 0))
        return [c[a:b] for c in self.columns[2:]]

    def together(self, ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(index of the document, columns) of the records of several documents."""
        spans = [self.rows.get(k, (0, 0)) for k in zip(ids.tolist(), ties.tolist(), strict=True)]
        at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(spans)), [b - a for a, b in spans]), [c[at] for c in self.columns[2:]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ..., start[i] + count[i] - 1 for all i."""
    count = count.astype(np.int64)
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts
