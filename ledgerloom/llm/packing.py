"""Best-fit packing (op 10): hierarchical residual packing of token pieces into sequences of a fixed length.

Round 0 packs each partition's pieces best-fit decreasing and emits the bins that are nearly full.  The other bins become
items of the next round: they are dealt into groups of bounded size, packed best-fit again, and so on, each round
merging the leftovers of several groups, until one group holds them all or a round closes nothing more.  A group never
exceeds ``GROUP_ROWS`` bins, so no task gathers an unbounded number; what still is open at the end is emitted as it is.

Token ids are those of the public byte-level BPE file.  Where the file asks for plain byte-level BPE with the usual pre-token pattern,
``ByteTokenizer`` runs its vocabulary with the faster of the two installed libraries, which gives the same ids; any other
file goes through the ``tokenizers`` library itself.

Defined results: a null or empty text is its end token alone; a very long text is tokenized whole; a document longer than a sequence is cut
into whole sequences with the shorter piece first; equal lengths are packed in the order of their rows; rows with a repeated or null id are
packed as documents of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._arrays import release
from ledgerloom.llm._spark import cut

SEQUENCE, END_ID = 2048, 0
#: A bin with at most so many free places is emitted at once; groups of bins in a merging round; rounds at most.
NEARLY, GROUP_ROWS, ROUNDS = 8, 40_000, 6

#: The pre-token pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What a file must ask for if PATTERN and plain byte pairs are to give its ids.
PLAIN = {
    "normalizer": None, "truncation": None, "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def is_plain(said: dict) -> bool:
    """Is the file's text handling the one that ``ByteTokenizer`` runs, its vocabulary in the order of its merges, and its added tokens taken literally?"""
    at = lambda want, got: all(at(w, got.get(k) or {}) if isinstance(w, dict) else (got.get(k) or None) == (w or None) for k, w in want.items())
    added = said.get("added_tokens") or ()
    special = {t["content"] for t in added}
    merged = [said["model"]["vocab"].get("".join(m if not isinstance(m, str) else m.split(" "))) for m in said["model"].get("merges", ())]
    in_order = None not in merged and all(a < b for a, b in zip(merged, merged[1:], strict=False))
    known = set(byte_alphabet())
    return at(PLAIN, said) and in_order and all(known.issuperset(t) for t in said["model"]["vocab"] if t not in special) and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))


class LibraryTokenizer:
    """Ids of any file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()

    def ids(self, text: str | None) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids if text else []


class ByteTokenizer:
    """Ids of a plain byte-level BPE vocabulary file; added tokens in a text count as such, as the file's own library has it."""

    def __init__(self, said: dict):
        import tiktoken

        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in said.get("added_tokens", ())}
        vocabulary = said["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.special = set(special)
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.coder.encode(text, allowed_special=self.special, disallowed_special=())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer | LibraryTokenizer:
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    out = ByteTokenizer(said) if is_plain(said) else LibraryTokenizer(path)
    said = None
    release()
    return out


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, a shorter one first."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, *, vocabulary: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    path = vocabulary or default_vocabulary()
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*coder.ids(text.as_py()), END_ID], "<u4")
                rows += [(doc_id.as_py(), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), size))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            rows = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return chosen.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset of each item in its bin, fill of each bin)."""
    bin_of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the sizes of gap that occur, ascending
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(fill), size
            fill.append(0)
        else:
            room = rooms[k]
            b = heapq.heappop(by_room[room])
            if not by_room[room]:
                rooms.pop(k)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            if not by_room[left]:
                insort(rooms, left)
            heapq.heappush(by_room[left], b)
    return bin_of, offset, np.array(fill, np.int64)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _names(level: int, group: int, bins: np.ndarray) -> np.ndarray:
    """Distinct numbers of bins: 3 bits of level, 28 of the partition or group, 32 of the bin in it."""
    return bins + ((level << 60) | (group << 32))


def _place(size: int, most: int):
    """Packs the pieces of a partition, in runs of about ``most`` rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, kept, base = TaskContext.get().partitionId(), [], 0

        def placed():
            nonlocal kept, base
            t = pa.Table.from_batches(kept)
            bin_of, offset, fill = best_fit(t.column("length").to_numpy(), size)
            names, kept = _names(0, part, bin_of + base), []
            base += len(fill)
            return t.append_column("bin", pa.array(names)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bin_of])).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
            if sum(b.num_rows for b in kept) >= most:
                yield from placed()
        if kept:
            yield from placed()

    return local


def _merge(level: int, size: int):
    """Packs the open bins of a group into bins of the next level."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bin_of, offset, fill = best_fit(pdf["fill"].to_numpy(), size)
        return pd.DataFrame({"bin": pdf["bin"], "into": _names(level, int(pdf["grp"].iloc[0]), bin_of), "shift": offset, "into_fill": fill[bin_of]})

    return merge


def pack(pieces: DataFrame, *, size: int = SEQUENCE, nearly: int = NEARLY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The placed pieces and every round's moves of open bins are stored in the shared folder, so a lost executor repeats
    neither tokenization nor earlier rounds.  Moves of bins are a few hundredths of the rows.
    """
    first = cut(pieces.mapInArrow(_place(size, 4 * group_rows), _PLACED))
    moved: list[DataFrame] = []
    open_bins, before = first.where(F.col("fill") < size - nearly).groupBy("bin").agg(F.first("fill").alias("fill")), None
    for level in range(1, rounds + 1):
        n = open_bins.count()
        if n < 2 or (before is not None and n >= 0.98 * before):
            break
        before, groups = n, -(-n // group_rows)
        dealt = open_bins.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
        moves = cut(dealt.groupBy("grp").applyInPandas(_merge(level, size), "bin long, into long, shift long, into_fill long"))
        moved.append(moves)
        if groups == 1:
            break
        open_bins = moves.where(F.col("into_fill") < size - nearly).groupBy(F.col("into").alias("bin")).agg(F.first("into_fill").alias("fill"))
    out = first
    for moves in moved:
        out = out.join(moves.select("bin", "into", "shift"), "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
