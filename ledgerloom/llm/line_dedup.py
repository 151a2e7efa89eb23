"""Line dedup (op 5): an exact set-similarity join of lines, which removes later matches.

A line's set is that of its distinct words.  A line with a word goes if an earlier line of the corpus (smaller doc_id, or same document,
smaller line number) has a set of Jaccard similarity ``THRESHOLD`` or more, whether or not that line goes itself.

Equal sets are collapsed first: lines meet by a digest of their sets, in a batch and then by bucket, the earliest is the set's leader,
and a line whose text, or whose words if the texts differ, is found to equal the leader's goes.  A line that shares a digest with another
set stays a leader of its own.  A copy's leader decides for it, so only leaders go on, each with its text.

The join of leaders is a prefix filter: words are ordered by rarity, and two similar sets share one of their first
``size - ceil(t * size) + 1`` words.  Rarity comes from counts of hashed words, an array of ``SKETCH`` numbers whatever the corpus;
any order gives the same result, so collisions only cost time.  Sets too small to be similar to any but themselves have no postings.
Postings meet by word.  The length and positional filters apply, then a filter by parities (the bits in which
two sets' hashed parities differ never outnumber the words in which they differ).  What passes is verified on whole
word sets.  A later line takes the partners of a word whose parities differ least: ``FIRST`` if the nearest differs by less
than half of what is allowed, ``UNSURE`` times as many if it doesn't.  If none of them verifies though it had more, the join is
repeated for such lines with all of their partners.

Defined results: null and empty texts have no lines to remove; very long texts, and very long lines, are read whole; equal lines of one
document keep the first; rows of one doc_id are ordered by their texts, equal rows each count; a null doc_id is the last one; extra columns,
whatever their names, are ignored or kept as they are; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _arrays as A
from ledgerloom.llm import _exchange as X
from ledgerloom.llm._spark import LAST_ID, cut

#: The threshold as a fraction, the sketch's counters, and partners kept at first.
THRESHOLD, SKETCH, FIRST, UNSURE = (4, 5), 1 << 20, 2, 24
#: From so many words on, a line has 128 parities, else 64; a word's group of more lines is joined pivot by pivot.
LONG_LINE, LARGE_GROUP = 96, 1500
#: First words of lines that a repeated join may tell all tasks about; if there are more of them, it goes through all postings.
TOLD_WORDS = 1_000_000

_POSTING = (np.uint32, np.uint64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32)  # word, parity, size, position, doc_id, tie, line, home bucket
_WIDE = (np.uint64,)  # of long lines: one of two words of their parities
_LEADER = (np.uint64, np.int64, np.int64, np.int32)  # digest, doc_id, tie, line
_LINE = (np.int64, np.int64, np.int32)  # doc_id, tie, line
LEADERS, COPIES, ASKED, COUNTS = 1, 2, 3, 4  # kinds of blobs
#: Counters of a block, which travel together.
COUNT_BLOCK = 1 << 12
#: Bits of the filter that tells all tasks which leaders are asked for, whatever their number, and of its blocks; a full filter only costs time.
ASKED_BITS, ASKED_BLOCK = 1 << 25, 1 << 20
#: Bytes of documents that are read together, and of leaders that travel together.
PIECE_BYTES, LEADER_BYTES = 4 << 20, 4 << 20
PAIR = "x_doc long, x_tie long, x_line int, x_home int, y_doc long, y_tie long, y_line int, y_home int, more boolean"


def _codes(h: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """35 bits by which words are ordered before their whole hashes."""
    code = h >> np.uint64(29)
    return code if weight is None else (code >> np.uint64(7)) | (weight[h & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(28))


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line number, start, end) of each line with a word, then (row of its line, hash) of each of their words."""
    ls, le, lfirst = A.lines(data, offsets)
    starts, ends, _ = A.words(data, offsets)
    own = np.searchsorted(starts, ls)
    n_words = np.searchsorted(starts, le) - own
    chosen = np.flatnonzero(n_words > 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(lfirst))[chosen]
    row = np.repeat(np.arange(len(chosen)), n_words[chosen])
    at = np.arange(len(row)) + np.repeat(own[chosen] - np.cumsum(n_words[chosen]) + n_words[chosen], n_words[chosen])
    return doc, (chosen - lfirst[doc]).astype(np.int32), ls[chosen], le[chosen], row, A.span_hashes(data, starts[at], ends[at])


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of texts."""
    starts, ends, first = A.words(data, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), A.span_hashes(data, starts, ends)


def distinct_words(n: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each of n lines, their distinct words, line after line) of the words (row of its line, hash).

    The order of a line's words is the same total order for all lines: by ``weight`` of the hash's bucket, then by hash.
    """
    code = _codes(h, weight)
    key = (row.astype(np.uint64) << np.uint64(35)) | code
    order = np.argsort(key)
    key, sorted_ = key[order], h[order]
    tied = np.flatnonzero((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1]))
    if len(tied):  # different words with one code: settled by whole hashes
        order = np.lexsort((h, code, row))
        sorted_ = h[order]
    row = row[order]
    new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
    row, h = row[new], sorted_[new]
    return np.searchsorted(row, np.arange(n + 1)), h


def _digest(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64 bits of each set; the order of its words doesn't matter."""
    return A.mix(np.add.reduceat(A.mix(h + np.uint64(11)), first[:-1])) if len(first) > 1 else np.zeros(0, np.uint64)


def settle(digest: np.ndarray, place: Sequence[np.ndarray], text: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(leaders, copies): rows of the lines (digest, place in the corpus), each copy found equal to its leader."""
    order = np.lexsort((*reversed(place), digest))
    d = digest[order]
    new = np.concatenate([[True], d[1:] != d[:-1]]) if len(order) else np.zeros(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else new
    more: dict[int, list[tuple[frozenset, int]]] = {}  # digests of several sets
    for i in np.flatnonzero(~new).tolist():
        own, first = text(order[i]), text(order[lead[i]])
        if own == first or (words := frozenset(own.split())) == frozenset(first.split()):
            continue
        if not any(words == w for w, _ in more.setdefault(int(lead[i]), [])):
            more[int(lead[i])].append((words, i))
            new[i] = True
    return np.sort(order[new]), np.sort(order[~new])


def _blobs_of_lines(bucket: np.ndarray, columns: Sequence[np.ndarray], kind: int) -> pa.RecordBatch:
    return X.scatter(bucket.astype(np.int32), columns, kind)


def collapsed(docs: DataFrame, n: int) -> DataFrame:
    """Of ``numbered`` documents blobs of the leaders, with their texts, by bucket of their digest, of the copies, and of how often words occur."""

    def send(ids, ties, data, offsets, total):
        doc, line, start, end, row, h = line_words(data, offsets)
        if not len(doc):
            return
        digest = _digest(*distinct_words(len(doc), row, h))
        place = [ids[doc], ties[doc], line]
        lead, copies = settle(digest, place, lambda i: data[start[i] : end[i]].tobytes())
        kept = np.zeros(len(doc), bool)
        kept[lead] = True
        total += np.bincount((h[kept[row]] & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield X.scatter_texts((digest[lead] % np.uint64(n)).astype(np.int32), [c[lead] for c in (digest, *place)], data, start[lead], end[lead] - start[lead], LEADERS)
        if len(copies):
            yield _blobs_of_lines(np.full(len(copies), int(digest[copies[0]] % np.uint64(n))), [c[copies] for c in place], COPIES)

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = A.string_buffers(batch.column(2))
            for lo, hi, d, o in A.pieces(data, offsets, PIECE_BYTES):
                yield from send(ids[lo:hi], ties[lo:hi], d, o, total)
            A.release()
        yield _count_blobs(total, n)

    def add(blobs):
        total: dict[int, np.ndarray] = {}
        for block, *counts in (X.unpack(b, (np.int64,) * 2) for b in blobs):
            total[int(block[0])] = total.get(int(block[0]), 0) + counts[0]
        return total

    def meet(bucket, found):
        counts = np.zeros((SKETCH // COUNT_BLOCK, COUNT_BLOCK), np.int64)
        for block, own in add(found.get(COUNTS, ())).items():
            counts[block] = own
        yield _count_blobs(counts.reshape(-1), n)
        for blob in found.get(COPIES, []):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([COPIES], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
        if LEADERS not in found:
            return
        parts = [X.unpack_texts(b, _LEADER) for b in found[LEADERS]]
        digest, *place = (np.concatenate([p[0][i] for p in parts]) for i in range(len(_LEADER)))
        data, offsets = np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        del parts
        lead, copies = settle(digest, place, lambda i: data[offsets[i] : offsets[i + 1]].tobytes())
        if len(copies):
            yield _blobs_of_lines(np.full(len(copies), bucket), [c[copies] for c in place], COPIES)
        lead = lead[np.lexsort([c[lead] for c in reversed(place)])]
        size = offsets[lead + 1] - offsets[lead]
        for own in np.split(lead, np.flatnonzero(np.diff(np.cumsum(size) // LEADER_BYTES)) + 1):
            yield X.scatter_texts(np.full(len(own), bucket, np.int32), [c[own] for c in place], data, offsets[own], offsets[own + 1] - offsets[own], LEADERS)

    return cut(X.by_bucket(docs.select("doc_id", "tie", "text").mapInArrow(run, X.BLOBS), meet, X.BLOBS))


def _count_blobs(total: np.ndarray, n: int) -> pa.RecordBatch:
    """Blobs of the blocks of counters that aren't all 0, each with the block's number, by bucket of the block."""
    parts = total.reshape(-1, COUNT_BLOCK)
    full = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_arrays([pa.array(full % n, pa.int32()), pa.array(np.full(len(full), COUNTS), pa.int32()), pa.array([X.pack([np.full(COUNT_BLOCK, i), parts[i]]) for i in full], pa.binary())], names=["bucket", "kind", "blob"])


def _over_leaders(lines: DataFrame, work: Callable[..., Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(bucket, places, data, offsets) on each blob of leaders."""

    def run(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from work(bucket, *X.unpack_texts(blob.as_py(), _LINE))
            A.release()

    return lines.where(F.col("kind") == LEADERS).select("bucket", "blob").mapInArrow(run, schema)


def word_counts(lines: DataFrame) -> np.ndarray:
    """How often the words of each hash bucket occur in lines that no line of their batch equals; SKETCH counters."""
    out = np.zeros((SKETCH // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for r in lines.where(F.col("kind") == COUNTS).select("blob").collect():  # a row for each block
        block, counts = X.unpack(bytes(r.blob), (np.int64, np.int64))
        out[block[0]] = counts
    return out.reshape(-1)


def _least_overlap(total: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Words that two sets of ``total`` words together share at least, if their similarity is t."""
    a, b = t
    return -(-a * total // (a + b))


def _weights(counts: np.ndarray) -> np.ndarray:
    """Rarity in 127 steps of the logarithm."""
    return np.minimum(127, np.log2(counts + 1.0) * 3).astype(np.uint8)


def _key(doc: np.ndarray, tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    return A.join2(A.join2(doc.astype(np.uint64), tie.astype(np.uint64)), line.astype(np.uint64))


def _prefix_length(size: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    return size - -(-t[0] * size // t[1]) + 1


def _parities(bit: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two words of 64 parities of each line, from the mixed hashes of its words."""
    place, plane = np.uint64(1) << (bit & np.uint64(63)), (bit >> np.uint64(6)) & np.uint64(1)
    return [np.bitwise_xor.reduceat(np.where(plane == k, place, np.uint64(0)), first[:-1]) for k in range(2)]


def _smallest(t: tuple[int, int]) -> int:
    """The least size of a set that can be similar to another one: t of the size + 1 is the size or less."""
    return -(-t[0] // (t[1] - t[0]))


def _postings(lines: DataFrame, counts: np.ndarray, n: int, t: tuple[int, int]) -> DataFrame:
    """Blobs of the leaders' first words by word bucket."""
    shared = lines.sparkSession.sparkContext.broadcast(_weights(counts))  # SKETCH bytes
    least = _smallest(t)

    def run(home, place, data, offsets):
        first, h = distinct_words(len(offsets) - 1, *word_rows(data, offsets), shared.value)
        if not len(h):
            return
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        bit = A.mix(h)
        halves = _parities(bit, first)
        position = np.arange(len(h)) - first[row]
        taken = np.flatnonzero((position < _prefix_length(size, t)[row]) & (size[row] >= least))
        own = row[taken]
        bucket = (bit[taken] % np.uint64(n)).astype(np.int32)
        wide = size[own] >= LONG_LINE
        columns = [(h[taken] >> np.uint64(32)).astype(np.uint32), (halves[0] ^ halves[1])[own], size[own].astype(np.int32), position[taken].astype(np.int32), *(c[own] for c in place), np.full(len(own), home, np.int32)]
        yield X.scatter(bucket[~wide], [c[~wide] for c in columns], 0)
        if wide.any():
            yield X.scatter(bucket[wide], [*(c[wide] for c in columns), halves[0][own[wide]]], 1)

    return _over_leaders(lines, run, X.BLOBS)


_ROW = "word long, doc long, tie long, line int, parity long, words array<bigint>"


def _prefix_rows(place, first, h, t, told=None) -> pa.RecordBatch:
    """A row with the whole set for each of the lines' first words, or for those where ``told`` has a line that may be similar."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    taken = np.flatnonzero(np.arange(len(h)) - first[row] < _prefix_length(size, t)[row])
    halves = _parities(A.mix(h), first)
    parity = halves[0] ^ halves[1]
    if told is not None:
        taken = taken[told.may_match(h[taken], parity[row[taken]], size[row[taken]], t)]
    own = row[taken]
    sets = pa.array([h[first[i] : first[i + 1]].view(np.int64) for i in own], pa.list_(pa.int64()))
    arrays = [pa.array(h[taken].view(np.int64)), *(pa.array(c[own], k) for c, k in zip(place, (pa.int64(), pa.int64(), pa.int32()), strict=True)), pa.array(parity[own].view(np.int64)), sets]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _ROW.split(", ")])


class Told:
    """First words of some lines, with the lines' parities and sizes: a bounded number, which all tasks get."""

    def __init__(self, word: np.ndarray, parity: np.ndarray, size: np.ndarray):
        order = np.argsort(word)
        self.word, self.parity, self.size = word[order], parity[order], size[order]

    def rows_with(self, h: np.ndarray) -> np.ndarray:
        """Places of the words that are told."""
        return np.flatnonzero(self.word[np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)] == h)

    def may_match(self, h: np.ndarray, parity: np.ndarray, size: np.ndarray, t: tuple[int, int]) -> np.ndarray:
        """Places of the words whose line passes the length and the parity filter with a told line of the same word."""
        at = self.rows_with(h)
        lo, hi = np.searchsorted(self.word, h[at]), np.searchsorted(self.word, h[at], "right")
        kept = [at[:0]]
        for part in _chunks(hi - lo, 500_000):
            count = hi[part] - lo[part]
            x = np.repeat(at[part], count)
            y = X.span_places(lo[part], count)
            total = size[x] + self.size[y]
            need = _least_overlap(total, t)
            bits = np.bitwise_count(parity[x] ^ self.parity[y]).astype(np.int64)
            kept.append(np.unique(x[(np.minimum(size[x], self.size[y]) >= need) & (bits <= total - 2 * need)]))
        return np.concatenate(kept)


def _joined_whole(lines: DataFrame, sets: DataFrame, counts: np.ndarray, t: tuple[int, int]) -> DataFrame:
    """(y_doc, y_tie, y_line) of those lines of ``sets`` that have any similar earlier line at all.

    The lines' first words are told to all tasks if they are few; each task then sends the leaders that have one of them among their
    own first words and may be similar to a line that has it, with their sets, and a join by word verifies.
    """
    weights = _weights(counts)

    def asked(batches):
        for batch in batches:
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            if not len(size) or not size.sum():
                continue
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            h = h[np.lexsort((h, _codes(h, weights), row))]
            yield _prefix_rows([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.append(0, np.cumsum(size)), h, t)

    ys = cut(sets.select("doc", "tie", "line", "words").mapInArrow(asked, _ROW), small=True)
    found = ys.select("word", "parity", F.size("words").cast("long").alias("size")).limit(TOLD_WORDS + 1).toArrow()
    told = None
    if 0 < len(found) <= TOLD_WORDS:
        word, parity, size = (c.to_numpy() for c in found.columns)
        told = Told(word.view(np.uint64), parity.view(np.uint64), size)
    shared = lines.sparkSession.sparkContext.broadcast((weights, told))  # SKETCH bytes, 24 for each of TOLD_WORDS at most

    def tell(_, place, data, offsets):
        weights, told = shared.value
        row, h = word_rows(data, offsets)
        rows = np.arange(len(offsets) - 1)
        if told is not None:  # only lines that have a told word
            rows = np.unique(row[told.rows_with(h)])
            kept = np.isin(row, rows)
            row, h = np.searchsorted(rows, row[kept]), h[kept]
        if len(rows):
            yield _prefix_rows([c[rows] for c in place], *distinct_words(len(rows), row, h, weights), t, told)

    xs = _over_leaders(lines, tell, _ROW)
    named = lambda df, s: df.select("word", *(F.col(c).alias(f"{s}_{c}") for c in ("doc", "tie", "line", "parity", "words")))
    nx, ny, shared_words = F.size("x_words"), F.size("y_words"), F.size(F.array_intersect("x_words", "y_words"))
    earlier = F.struct("x_doc", "x_tie", "x_line") < F.struct("y_doc", "y_tie", "y_line")
    near = F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity"))) * (t[0] + t[1]) <= (nx + ny) * (t[1] - t[0])
    x, y = named(xs, "x"), named(ys, "y")
    joined = x.join(y, (x.word == y.word) & earlier & near & ((t[0] + t[1]) * shared_words >= t[0] * (nx + ny)))
    return joined.select("y_doc", "y_tie", "y_line").distinct()


def _similar_pairs(p: dict, x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of postings of one word that pass the length, positional and parity filters, and how much of the allowed difference each shows."""
    sx, sy = p["size"][x], p["size"][y]
    need = _least_overlap(sx + sy, t)
    allowed = sx + sy - 2 * need
    at = np.flatnonzero((np.minimum(sx, sy) >= need) & (np.minimum(sx - p["position"][x], sy - p["position"][y]) >= need))
    x, y, allowed = x[at], y[at], allowed[at]
    differ = p["parity"][x] ^ p["parity"][y]
    bits = np.bitwise_count(differ).astype(np.int64)
    both = np.flatnonzero((bits <= allowed) & (p["wide"][x] >= 0) & (p["wide"][y] >= 0))
    if len(both):
        half = p["half"][p["wide"][x[both]]] ^ p["half"][p["wide"][y[both]]]
        bits[both] = np.bitwise_count(half).astype(np.int64) + np.bitwise_count(differ[both] ^ half)
    ok = bits <= allowed
    return at[ok], bits[ok] / np.maximum(allowed[ok], 1)


def candidates(lines: DataFrame, counts: np.ndarray, n: int, *, t: tuple[int, int] = THRESHOLD, first: int = FIRST) -> DataFrame:
    """Pairs (x earlier, y later) of leaders that passed the filters.

    At most ``first``, or ``first * UNSURE``, for a later line and word; ``more`` if there were more.
    """

    def join(_, found):
        narrow, wide = X.gather(found.get(0, []), _POSTING), X.gather(found.get(1, []), _POSTING + _WIDE)
        c = [np.concatenate(z) for z in zip(narrow, wide[: len(narrow)], strict=True)]
        ref = np.concatenate([np.full(len(narrow[0]), -1), np.arange(len(wide[0]))])
        # Words of one line only match nothing.
        order = _by_word(c[0], np.arange(len(c[0])))
        word = c[0][order]
        same = word[1:] == word[:-1]
        lone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(word) else np.zeros(0, bool)
        order = np.sort(order[~lone])
        c, ref = [z[order] for z in c], ref[order]
        doc, tie, line = c[4:7]
        simple = not len(order) or (doc.min() >= 0 and doc.max() < 1 << 40 and line.max() < 1 << 22 and not tie.any())
        time = np.argsort((doc << 22) | line) if simple else np.lexsort((line, tie, doc))
        c, ref = [z[time] for z in c], ref[time]
        # From here on rows are in the order of the corpus.
        side = lambda i: [pa.array(z[i]) for z in c[4:8]]

        def batch(x, y, more):
            return pa.RecordBatch.from_arrays([*side(x), *side(y), pa.array(more)], names=[k.split()[0] for k in PAIR.split(", ")])

        order = _by_word(c[0], np.arange(len(c[0])))
        p = {"size": c[2][order].astype(np.int64), "position": c[3][order], "parity": c[1][order], "wide": ref[order], "half": wide[8]}
        word = c[0][order]
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(order) else np.zeros(0, np.int64)
        length = np.diff(np.append(edge, len(order)))

        small = np.flatnonzero((length > 1) & (length <= LARGE_GROUP))
        for part in _chunks(length[small] * (length[small] - 1) // 2, 500_000):
            g = small[part]
            later = np.concatenate([np.arange(s, s + m) for s, m in zip(edge[g], length[g], strict=True)])
            at = later - np.repeat(edge[g], length[g])
            y = np.repeat(later, at)
            x = y - np.repeat(at, at) + (np.arange(len(y)) - np.repeat(np.cumsum(at) - at, at))
            ok, share = _similar_pairs(p, x, y, t)
            x, y = x[ok], y[ok]
            if len(y):
                sort = np.lexsort((x, share, y))
                x, y, share = x[sort], y[sort], share[sort]
                start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
                count = np.diff(np.append(start, len(y)))
                most = np.where(share[start] < 0.5, first, first * UNSURE)
                chosen = np.arange(len(y)) - np.repeat(start, count) < np.repeat(most, count)
                yield batch(order[x[chosen]], order[y[chosen]], np.repeat(count > most, count)[chosen])
        for g in np.flatnonzero(length > LARGE_GROUP):
            left = np.arange(edge[g], edge[g] + length[g])
            seen = np.zeros(length[g])
            for pivot in range(edge[g], edge[g] + length[g]):
                ys = left[np.searchsorted(left, pivot + 1) :]
                if not len(ys):
                    break
                ok, share = _similar_pairs(p, np.full(len(ys), pivot), ys, t)
                hit = ys[ok]
                if len(hit):
                    seen[hit - edge[g]] += np.where(share < 0.5, 1, 1 / UNSURE)
                    full = seen[hit - edge[g]] >= first - 1e-9
                    yield batch(np.full(len(hit), order[pivot]), order[hit], full)
                    left = np.setdiff1d(left, hit[full], assume_unique=True)

    return X.by_bucket(_postings(lines, counts, n, t), join, PAIR)


def _by_word(word: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ascending rows, ordered by their words of 32 bits."""
    return (np.sort((word[rows].astype(np.uint64) << np.uint64(32)) | rows.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _chunks(costs: np.ndarray, limit: int):
    """Index arrays of consecutive items of about ``limit`` cost each."""
    lo, total = 0, np.cumsum(costs)
    while lo < len(costs):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        yield np.arange(lo, hi)
        lo = hi


def _places_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each key."""
    return tuple((x % np.uint64(ASKED_BITS)).astype(np.int64) for x in (key, key >> np.uint64(32)))


def _asked_filter(asked: DataFrame) -> np.ndarray:
    """The bits of all asked leaders (doc, tie, line, ...), by blocks."""

    def mark(batches):
        bits = np.zeros(ASKED_BITS, bool)
        for batch in batches:
            for at in _places_of(_key(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))):
                bits[at] = True
        parts = np.packbits(bits).reshape(-1, ASKED_BLOCK // 8)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.zeros(len(full)), pa.int32()), pa.array([X.pack([parts[i]]) for i in full], pa.binary())], names=["bucket", "kind", "blob"])

    def merge(key, found):
        bits = np.bitwise_or.reduce([X.unpack(b, [np.uint8])[0] for b in found[0]])
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([0], pa.int32()), pa.array([X.pack([bits])], pa.binary())], names=["bucket", "kind", "blob"])

    out = np.zeros((ASKED_BITS // ASKED_BLOCK, ASKED_BLOCK // 8), np.uint8)
    for r in X.by_bucket(asked.mapInArrow(mark, X.BLOBS), merge, X.BLOBS).collect():  # a row for each block
        out[r.bucket] = X.unpack(bytes(r.blob), [np.uint8])[0]
    return out.reshape(-1)


def _sets_of(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, tie, line, words) of the asked leaders (doc, tie, line, home)."""
    shared = lines.sparkSession.sparkContext.broadcast(_asked_filter(asked.coalesce(2 * lines.sparkSession.sparkContext.defaultParallelism)))  # ASKED_BITS / 8 bytes

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                doc, tie, line, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                yield X.scatter(home.astype(np.int32), [doc, tie, line.astype(np.int32)], ASKED)

    def offer(home, place, data, offsets):
        bits, ok = shared.value, np.ones(len(offsets) - 1, bool)
        for at in _places_of(_key(*place)):
            ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        rows = np.flatnonzero(ok)
        if len(rows):
            yield X.scatter_texts(np.full(len(rows), home, np.int32), [c[rows] for c in place], data, offsets[rows], offsets[rows + 1] - offsets[rows], LEADERS)

    def work(_, found):
        wanted = _key(*X.gather(found.get(ASKED, []), _LINE))
        if not len(wanted):
            return
        for blob in found.get(LEADERS, []):
            place, data, offsets = X.unpack_texts(blob, _LINE)
            rows = np.flatnonzero(np.isin(_key(*place), wanted))
            if len(rows):
                first, h = distinct_words(len(rows), *word_rows(*X.span_data(data, offsets[rows], offsets[rows + 1] - offsets[rows])))
                sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in place), sets], names=["doc", "tie", "line", "words"])

    offered = _over_leaders(lines, offer, X.BLOBS)
    return X.by_bucket(offered.unionByName(asked.select("doc", "tie", "line", "home").mapInArrow(ask, X.BLOBS)), work, "doc long, tie long, line int, words array<bigint>")


def _sides(pairs: DataFrame) -> DataFrame:
    side = lambda s: pairs.select(*(F.col(f"{s}_{c}").alias(c) for c in ("doc", "tie", "line", "home")))
    return side("x").unionByName(side("y")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs whose word sets are similar enough."""
    named = lambda s: sets.select(F.col("doc").alias(f"{s}_doc"), F.col("tie").alias(f"{s}_tie"), F.col("line").alias(f"{s}_line"), F.col("words").alias(f"{s}_words"))
    joined = pairs.join(named("x"), ["x_doc", "x_tie", "x_line"]).join(named("y"), ["y_doc", "y_tie", "y_line"])
    shared = F.size(F.array_intersect("x_words", "y_words"))
    total = F.size("x_words") + F.size("y_words")
    return joined.where((t[0] + t[1]) * shared >= t[0] * total)


def _copies(lines: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                doc, tie, line = X.unpack(blob.as_py(), _LINE)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(line)], names=["doc", "tie", "line"])

    return lines.where(F.col("kind") == COPIES).select("blob").mapInArrow(run, "doc long, tie long, line int")


def removed_lines(docs: DataFrame, *, t: tuple[int, int] = THRESHOLD, first: int = FIRST) -> DataFrame:
    """(doc, tie, line) of the lines to remove; ``docs`` are ``numbered``."""
    n = X.bucket_count(docs)
    lines = collapsed(docs, n)
    counts = word_counts(lines)
    x, y = ["x_doc", "x_tie", "x_line", "x_home"], ["y_doc", "y_tie", "y_line", "y_home"]
    pairs = candidates(lines, counts, n, t=t, first=first)
    near = cut(pairs.groupBy(*x, *y).agg(F.max("more").alias("more")), small=True)
    sets = cut(_sets_of(lines, cut(_sides(near), small=True)))
    passed = cut(_verified(near, sets, t).select(*y[:3]).distinct(), small=True)
    found = passed
    left = cut(near.where("more").select(*y[:3]).distinct().join(passed, y[:3], "left_anti"), small=True)
    if left.limit(1).count():
        named = left.toDF("doc", "tie", "line")
        found = found.unionByName(_joined_whole(lines, sets.join(named, ["doc", "tie", "line"], "left_semi"), counts, t))
    return found.toDF("doc", "tie", "line").unionByName(_copies(lines))


def line_report(docs: DataFrame, *, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of every document; line numbers from 0."""
    numbered = X.numbered(docs)
    gone = removed_lines(numbered, t=t).groupBy("doc", "tie").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = F.when(text == "", F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    base = numbered.select("doc_id", "tie", n_lines.cast("long").alias("n_lines"))
    out = base.join(gone, (base.doc_id == gone.doc) & (base.tie == gone.tie), "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select(F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def without_lines(docs: DataFrame, *, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with their removed lines taken out of ``text``; documents of which no line is left go, others keep all columns."""
    numbered = X.numbered(docs, rest=True)
    gone = removed_lines(numbered.drop("rest"), t=t).groupBy("doc", "tie").agg(F.collect_set("line").alias("gone"))
    text = F.col("rest")["text"].cast("string")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["x"]), "\n")
    out = numbered.drop("text").join(gone.withColumnRenamed("doc", "doc_id"), ["doc_id", "tie"], "left")
    out = out.where(F.col("gone").isNull() | (F.size("gone") < F.size(lines)))
    left = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return out.select(*(left.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
