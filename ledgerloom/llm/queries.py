"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontamination, language_id, line_dedup, near_dedup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity
from ledgerloom.llm._spark import cut, held_out, table


#: Runs of 20 words that aren't the first of their kind, and the words outside of all of them.
OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM doc WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM doc WHERE len(w) > 0
), kept AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""

#: Sets of distinct words of lines: later copies, and sets that are similar to an earlier one with a word among the rarest in common.
OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''
), line AS (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM split)
), ranked AS (
  SELECT doc_id, line, w, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS copy FROM line WHERE len(w) > 0
), lead AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, w, len(w) AS n FROM ranked WHERE copy = 1
), word AS (
  SELECT id, n, unnest(w) AS x FROM lead
), often AS (
  SELECT x, count(*) AS c FROM word GROUP BY x
), prefix AS (
  SELECT id, n, x FROM (SELECT id, n, word.x, row_number() OVER (PARTITION BY id ORDER BY c, word.x) AS r FROM word JOIN often ON word.x = often.x) WHERE r <= n - (4 * n + 4) // 5 + 1
), pair AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), gone AS (
  SELECT doc_id, line FROM ranked WHERE copy > 1
  UNION SELECT q.doc_id, q.line FROM pair JOIN lead p ON p.id = pair.a JOIN lead q ON q.id = pair.b WHERE 9 * len(list_intersect(p.w, q.w)) >= 4 * (p.n + q.n)
), per AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(split.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed, coalesce(per.removed, '') AS removed_lines
FROM documents d LEFT JOIN split ON split.doc_id = d.doc_id LEFT JOIN per ON per.doc_id = d.doc_id
"""

#: Strings of 50 bytes as hexadecimal text; the runs that strings of smaller documents cover, and what is left between them.
OP6_SQL = r"""
WITH doc AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), win AS (
  SELECT doc_id, s, substr(h, 2 * s - 1, 100) AS w FROM (SELECT doc_id, h, unnest(generate_series(1, n - 49)) AS s FROM doc WHERE n >= 50)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE least < doc_id
), run AS (
  SELECT doc_id, first, last + 49 AS last FROM (
    SELECT doc_id, min(s) AS first, max(s) AS last FROM (
      SELECT doc_id, s, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k
      FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM again)) GROUP BY doc_id, k)
), piece AS (
  SELECT run.doc_id, first, last, substr(h, 2 * (coalesce(lag(last) OVER w, 0) + 1) - 1, 2 * (first - 1 - coalesce(lag(last) OVER w, 0))) AS kept
  FROM run JOIN doc ON run.doc_id = doc.doc_id WINDOW w AS (PARTITION BY run.doc_id ORDER BY first)
), cut AS (
  SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS reached, string_agg(kept, '' ORDER BY first) AS kept FROM piece GROUP BY doc_id
)
SELECT doc.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(reached, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut ON doc.doc_id = cut.doc_id
"""

#: Windows of 13 words of items and documents, compared as text; n_hit counts words within matching windows.
OP7_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item_window AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc JOIN lengths ON len(w) >= n)
), hit AS (
  SELECT d.doc_id, d.s, d.n, i.item_id FROM doc_window d JOIN item_window i ON d.n = i.n AND d.words = i.words
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.joined, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.classify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"))
    return report.withColumn("removed_lines", F.array_join("removed_lines", ","))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    network, learned = toxicity.learn(docs, labels, language_id.fit(docs))
    found = toxicity.logits(docs, network)
    if network is not None:
        found = cut(found)  # calibration and scores read it
        toxicity.calibrate(network, found, labels, learned)
    predicted = (F.col("score") >= toxicity.DECISION).cast("int")
    return toxicity.scores(found, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "language")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_order_minhash,
        op2_substring_dedup,
        op3_token_counts,
        op4_language_id,
        op5_line_dedup,
        op6_suffix_array_dedup,
        op7_benchmark_decontamination,
        op8_toxicity,
        op9_quality_rules,
        op10_best_fit_packing,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Statements only where one can express the whole result on whole tables."""
    return {"op2_substring_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op6_suffix_array_dedup": OP6_SQL, "op7_benchmark_decontamination": OP7_SQL}
