"""Language ID (op 4): compression with a zstandard raw-content dictionary for each language.

A lower-cased text is cut into blocks of ``BLOCK`` bytes, every block is compressed with every language's
dictionary, and the language whose total is smallest wins.  Blocks are short so that a text's own repetitions
don't outweigh the dictionaries.  A block of under ``SHORT`` bytes, too short for the compressor to gain
anything, follows ``PAD`` bytes of the dictionary, whose own size is taken off.  The margin between the two smallest
totals, as a share of the smaller, decides on rejection: a text whose margin is under ``MIN_MARGIN``,
or that has no letter, is rejected.

A dictionary is a sample of blocks of ``SAMPLE_BLOCK`` characters, drawn by hash from all places of all labelled texts of its language, up
to ``DICTIONARY_BYTES``.  Every language that labels name has one: only where they are so many that their dictionaries together would
exceed ``MODEL_BYTES`` each gets an equal share of that.

Defined results: null, empty and letterless texts are ``und`` with score 0; very long texts are compressed block by block, whole; equal
totals take the language with more labelled documents, with margin 0; repeated rows give repeated results; extra columns, whatever
their names, are ignored or kept as they are; an empty table gives no rows; with no labelled text everything is ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._arrays import release
from ledgerloom.llm._spark import held_out

LETTER = re.compile(r"[^\W\d_]")
BLOCK, SHORT, PAD = 512, 160, 256
#: The fitted sample: characters of a drawn block, bytes of a language's dictionary and of all dictionaries, at most.
SAMPLE_BLOCK, DICTIONARY_BYTES, MODEL_BYTES = 400, 96 << 10, 32 << 20
MIN_MARGIN = 0.002


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the most frequent first, and the raw content of each one's dictionary."""

    content: tuple[tuple[str, bytes], ...]

    def sizes(self, text: str) -> list[int]:
        raw, tools = _bytes(text), _compressors(self)
        out = [0] * len(tools)
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            for k, (c, pad, own) in enumerate(tools):
                out[k] += len(c.compress(block)) if len(block) >= SHORT else len(c.compress(pad + block)) - own
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the score is 0.5 for two equal totals and nears 1 as they part."""
        if not text or not LETTER.search(text) or not self.content:
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.content[0][0], 1.0, 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.content[order[0]][0], 1 / (1 + math.exp(-min(second - best, 40))), (second - best) / max(1, best)


@lru_cache(maxsize=4)
def _compressors(model: LanguageModel) -> list[tuple[zstandard.ZstdCompressor, bytes, int]]:
    out = []
    for _, raw in model.content:
        given = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=17, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=given)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=given)
        pad = raw[len(raw) // 4 :][:PAD]
        out.append((c, pad, len(c.compress(pad))))
    return out


def fit(docs: DataFrame, *, dictionary_bytes: int = DICTIONARY_BYTES, model_bytes: int = MODEL_BYTES) -> LanguageModel:
    """Dictionaries of about ``dictionary_bytes`` for each language, of blocks drawn by a hash from all labelled texts.

    Only rows with text, language and a doc_id that isn't held out count.  One pass counts blocks by language, the next takes the
    fraction of them that fills the dictionaries, so no group is gathered in a task and the driver gets the model's size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id")))
    blocks = F.ceil(F.char_length("text") / SAMPLE_BLOCK).cast("int")
    counts = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(blocks.cast("long")).alias("blocks")).orderBy(F.desc("n"), "lang").collect()}  # a row for each language
    if not counts:
        return LanguageModel(())
    own_bytes = min(dictionary_bytes, model_bytes // len(counts))
    wanted = 1.5 * own_bytes / SAMPLE_BLOCK + 4
    share = F.element_at(F.create_map(*(F.lit(x) for lang, r in counts.items() for x in (lang, min(1 << 40, math.ceil(wanted / r.blocks * (1 << 40)))))), F.col("lang"))
    keyed = rows.select("lang", "text", share.alias("share"), F.xxhash64("doc_id", "text", F.lit("sample")).alias("key"), blocks.alias("blocks"))
    place = lambda i: F.pmod(F.xxhash64("key", i), F.lit(1 << 40))
    chosen = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(i) < F.col("share"))
    drawn = keyed.select("lang", "text", "key", F.explode(chosen).alias("i")).select("lang", place(F.col("i")).alias("place"), F.substring("text", F.col("i") * SAMPLE_BLOCK + 1, F.lit(SAMPLE_BLOCK)).alias("block"))
    got: dict[str, list] = {k: [] for k in counts}
    for r in drawn.collect():  # 1.5 times the dictionaries
        got[r.lang].append((r.place, r.block))
    content = [(lang, b"\n".join(_bytes(t) for _, t in sorted(got[lang]))[:own_bytes]) for lang in counts]
    return LanguageModel(tuple((lang, raw) for lang, raw in content if len(raw) > 8))


def classify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))), pa.array([_rejected(x, min_margin) for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that aren't rejected, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not _rejected(shared.value.predict(t.as_py()), min_margin) for t in batch.column(at)], pa.bool_()))
            release()

    return docs.mapInArrow(keep, docs.schema)


def _rejected(found: tuple[str, float, float], min_margin: float) -> bool:
    return found[0] == "und" or found[2] < min_margin
