"""Token counts (op 3): best unigram segmentation of every pre-token, with prefixes shared in a trie.

A pre-token is a run without ASCII white space, behind the word mark.  Its tokens are the pieces of the segmentation with
the largest sum of scores; a character that is no piece falls back to one token for each of its UTF-8 bytes.  The forward
score of a prefix depends on the prefix alone, so distinct pre-tokens are inserted in a trie whose nodes hold the forward
score and the number of tokens so far: each shared prefix is computed once, and a terminal's numbers are its word's.

Pieces and their order come from a public vocabulary file; a piece's score is the logarithm of a Zipf weight of its
place, as the file has places and no probabilities.  A full trie (``MAX_NODES``) is emptied; that costs time, never results.
Beyond ``MAX_DEPTH`` characters of a pre-token no nodes are made and the forward scores run on in a window.

Defined results: null and empty texts have no tokens and score 0; very long texts and very long pre-tokens are counted whole; equal sums take
the segmentation with fewer tokens; repeated rows repeat results; a null id is returned as null; extra columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
MAX_NODES, MAX_DEPTH = 1_000_000, 64
_CODES = 0x110000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def piece_scores(path: str) -> dict[str, float]:
    """Score of every ordinary piece of a sentencepiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 3) for k in range(len(ordinary))))
    return {model.id_to_piece(i): -math.log(k + 3) - total for k, i in enumerate(ordinary)}


def byte_score(scores: dict[str, float]) -> float:
    """Score of one byte of a character that is no piece: well below every piece."""
    return min(scores.values(), default=0.0) - 10.0


class ForwardTrie(dict):
    """word -> (tokens, score), computed on first reading."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH):
        self.scores, self.max_nodes, self.max_depth = scores, max_nodes, max_depth
        self.longest, self.byte = max(map(len, scores), default=1), byte_score(scores)
        self.begun = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.nodes_made = 0
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}  # node and character -> node
        self.best, self.tokens = [0.0], [0]

    def _forward(self, word: str, starts: list[int], end: int, best: list[float], tokens: list[int], base: int) -> tuple[float, int]:
        """Best score and tokens of word[:end], from those of its prefixes word[:start]; best and tokens begin at prefix ``base``."""
        scores, top, count = self.scores, -math.inf, 0
        for start in starts:
            s = scores.get(word[start:end])
            if s is None:
                if start < end - 1:
                    continue
                n = len(word[start].encode("utf-8", "surrogatepass"))
                s = n * self.byte
            else:
                n = 1
            s += best[start - base]
            n += tokens[start - base]
            if s > top or (s == top and n < count):
                top, count = s, n
        return top, count

    def _starts(self, word: str, end: int, before: list[int] | None) -> list[int]:
        """Where pieces that reach word[end - 1] can begin; narrowed from those of end - 1 if they are known."""
        begun = self.begun
        if before is None:
            before = range(max(0, end - self.longest), end - 1)
        out = [s for s in before if word[s:end] in begun]
        out.append(end - 1)
        return out

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self.best) > self.max_nodes:
            self._empty()
        text, node, child = MARK + word, 0, self.child
        best, tokens, starts = [0.0], [0], None
        depth = min(len(text), self.max_depth)
        for end in range(1, depth + 1):
            key = node * _CODES + ord(text[end - 1])
            node = child.get(key, -1)
            if node < 0:
                starts = self._starts(text, end, starts)
                s, n = self._forward(text, starts, end, best, tokens, 0)
                node = child[key] = len(self.best)
                self.best.append(s)
                self.tokens.append(n)
                self.nodes_made += 1
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        base = 0
        for end in range(depth + 1, len(text) + 1):
            starts = self._starts(text, end, starts)
            s, n = self._forward(text, starts, end, best, tokens, base)
            best.append(s)
            tokens.append(n)
            if len(best) > 4 * self.longest + 64:
                cut = len(best) - self.longest
                del best[:cut], tokens[:cut]
                base += cut
        found = tokens[-1], best[-1]
        if len(word) <= self.max_depth:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def shared_trie(path: str) -> ForwardTrie:
    """The trie of a Python worker, which lasts from task to task."""
    return ForwardTrie(piece_scores(path))


def token_counts(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_score) of every whole text."""
    path = vocabulary or default_vocabulary()
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared_trie(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                pairs = [trie[w] for w in WORD.findall(text.as_py() or "")]
                rows.append((len(pairs), sum(n for n, _ in pairs), math.fsum(s for _, s in pairs)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])

    return chosen.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long, log_score double")
