"""A corpus pipeline of five operators: each stage reads what its predecessor kept, as Parquet in the shared folder.

language: documents whose language is rejected go.  lines: repeated lines go, and documents of which no line is left.
near_duplicates: one document of each class stays.  decontaminate: contaminated documents go.  pack: what is left is packed
into sequences; its rows are the result.

Defined results: documents with a null or empty text, or one without letters, go with the first stage; a null doc_id counts as the last one;
very long texts are read whole by every stage; rows of one doc_id are documents of their own, ordered by their texts, and equal rows fall to the
lines stage; all stages but the last keep all columns, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, language_id, line_dedup, near_dedup, packing
from ledgerloom.llm._spark import fresh, shared_folder, table
from ledgerloom.sources.snapshots import remove_folder

#: SQL can't express the stages.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again, and what it wrote goes when the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/{fresh('pipeline')}", ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # stores what it reads
    remove_folder(spark, folder)
    return out
