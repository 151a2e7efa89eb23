"""Whole-batch text primitives on numpy arrays, used inside Arrow UDFs.

An Arrow string column already is one byte buffer with offsets, so words, lines and windows of a
batch are found by array operations without a Python object for each word.  Batches are cut into
pieces of about ``PIECE_BYTES`` at document borders; only a single longer document exceeds that.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

# The six ASCII white-space bytes that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of alphanumeric words: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240229)
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 2**63, 4096, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _trim():
    """The C library's malloc_trim where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives freed memory back to the system, as Python workers live on from stage to stage beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair of two hashes."""
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x1234567))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of whole documents of about ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes that stay within a document: (starts, ends, first run of each document)."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:][offsets[1:] > 0]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words: runs without white space, or runs of ``word_bytes``."""
    return spans(~SPACE[data] if word_bytes is None else word_bytes[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines (split at newline, empty ones too): (starts, ends, first line of each document).

    An empty document has one empty line.
    """
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    docs = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((starts, docs))
    starts = starts[order]
    ends = ends[np.lexsort((ends, np.concatenate([owner, np.arange(len(offsets) - 1)])))]
    first = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(offsets) - 1))]).astype(np.int64)
    return starts, ends, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, read in words of eight bytes; empty spans hash alike."""
    length = ends - starts
    out = mix(length.astype(np.uint64) * _STEP + np.uint64(1))
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    left, at, rows = length, starts, None
    while True:
        more = np.flatnonzero(left > 0)
        if not len(more):
            return out
        left, at = left[more], at[more]
        rows = more if rows is None else rows[more]
        taken = eight[at] & _MASKS[np.minimum(left, 8)]
        out[rows] = join2(out[rows], taken)
        left, at = left - 8, at + 8


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_BLOCK = 1 << 20
_BASE = int(_PLACES[7])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size, power = 1, base
    while size < n:
        out[size : 2 * size] = out[: min(size, n - size)] * np.uint64(power)
        power = power * power % 2**64
        size *= 2
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    return _powers(_BASE, 2 * _BLOCK), _powers(pow(_BASE, -1, 2**64), _BLOCK)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive hashes (a mixed polynomial modulo 2**64); shorter than h by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > _BLOCK:  # one run of a very long document's start: folded
        return join2(window_hashes(h[: len(h) - k // 2], k - k // 2), window_hashes(h[k - k // 2 :], k // 2))
    up, down = _tables()
    out = np.empty(n, np.uint64)
    for lo in range(0, n, _BLOCK):
        own = h[lo : lo + _BLOCK + k - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        d = sums[k:] - sums[:-k]
        d *= down[: len(d)]
        d += np.uint64(k)
        out[lo : lo + _BLOCK] = mix(d)
    return out


class WindowHashes:
    """``window_hashes`` of one array for several lengths, of all places or of some: the sums below are made once."""

    def __init__(self, h: np.ndarray):
        self.h, self.sums = h, None
        if len(h) <= _BLOCK:
            self.sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * _tables()[0][: len(h)], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        if self.sums is None or len(self.h) < k:
            return window_hashes(self.h, k)
        d = self.sums[k:] - self.sums[:-k]
        d *= _tables()[1][: len(d)]
        d += np.uint64(k)
        return mix(d)

    def at(self, k: int, places: np.ndarray) -> np.ndarray:
        """Hashes of the runs that begin at the places; each must lie within the array."""
        if self.sums is None:
            return window_hashes(self.h, k)[places]
        d = self.sums[places + k] - self.sums[places]
        d *= _tables()[1][places]
        d += np.uint64(k)
        return mix(d)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(x) < w:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The same as a stable argsort, by two vectorized sorts: of the keys, and of places within equal keys."""
    order = np.argsort(keys)
    if len(keys) < 2 or len(keys) >= 1 << 32:
        return np.argsort(keys, kind="stable")
    s = keys[order]
    group = np.zeros(len(keys), np.uint64)
    np.cumsum(s[1:] != s[:-1], out=group[1:])
    return (np.sort((group << np.uint64(32)) | order.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """True where one of n places lies in [start, start + length) of some start."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0
