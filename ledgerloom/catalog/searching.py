"""Full text, boxes and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog._registry import Registry
from ledgerloom.functions import vectors
from ledgerloom.operators import search
from ledgerloom.sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

_INDEX = "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS term, unnest(generate_series(0, len(ts) - 1)) AS position FROM t)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(read_table(spark, d, "documents"))


@query("fts_match", "SE-01 SRC-11", f"{_INDEX} SELECT DISTINCT doc_id FROM p WHERE term = 'thereading' OR term = 'idiot'")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return search.match_any(_index(spark, d), ["thereading", "idiot"])


@query("fts_all_without", "SE-02", f"{_INDEX} SELECT doc_id FROM p WHERE term IN ('of', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 2 AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'for')")
def fts_all_without(spark: SparkSession, d: str) -> DataFrame:
    return search.match_without(_index(spark, d), ["of", "the"], ["for"])


@query("fts_prefix", "SE-02", f"{_INDEX} SELECT DISTINCT doc_id FROM p WHERE term LIKE 'wort%'")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.match_prefix(_index(spark, d), "wort")


@query("fts_phrase", "SE-02", f"{_INDEX} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the'")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.match_phrase(_index(spark, d), ["of", "the"])


@query("fts_near", "SE-02", f"{_INDEX} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(b.position - a.position) <= 3 WHERE a.term = 'of' AND b.term = 'that'")
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    return search.match_near(_index(spark, d), "of", "that", 2)


@query("fts_bm25", "SE-02", f"""{_INDEX}, l AS (SELECT doc_id, count(*) AS len FROM p GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM p WHERE term IN ('idiot', 'trash') GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 5) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id) CROSS JOIN c GROUP BY tf.doc_id""")
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(read_table(spark, d, "documents"), ["idiot", "trash"]).select("doc_id", F.round("score", 5).alias("score"))


@query("fts_highlight", "SE-02")
def fts_highlight(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where(F.col("text").contains("idiot"))
    return docs.select("doc_id", search.highlight(F.col("text"), ["idiot"]).alias("marked"), search.snippet(F.col("text"), ["idiot"]).alias("snippet"))


@query("fts_after_write", "SE-03 SE-07", f"{_INDEX} SELECT term, count(*) AS n FROM p WHERE doc_id % 2 = 1 AND term IN ('of', 'the') GROUP BY term")
def fts_after_write(spark: SparkSession, d: str) -> DataFrame:
    """The index of a table after a delete is the index without the deleted rows' postings."""
    docs = read_table(spark, d, "documents")
    index = search.postings(docs).join(docs.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_anti")
    return index.where(F.col("term").isin("of", "the")).groupBy("term").agg(F.count("*").alias("n"))


@query("box_overlap", "SE-04 SRC-12", """
SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey, p_retailprice AS x0, p_retailprice + 2 AS x1, p_size AS y0, p_size + 1 AS y1 FROM part WHERE p_partkey % 2 = 0) a
JOIN (SELECT p_partkey, p_retailprice AS x0, p_retailprice + 1 AS x1, p_size AS y0, p_size + 3 AS y1 FROM part WHERE p_partkey % 2 = 1) b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    box = lambda odd, s, w, h: part.where(f"p_partkey % 2 = {odd}").select(F.col("p_partkey").alias(s), F.col("p_retailprice").alias(f"{s}x0"), (F.col("p_retailprice") + w).alias(f"{s}x1"), F.col("p_size").alias(f"{s}y0"), (F.col("p_size") + h).alias(f"{s}y1"))
    dims = lambda s: [(f"{s}x0", f"{s}x1"), (f"{s}y0", f"{s}y1")]
    return search.overlaps(box(0, "a", 2, 1), box(1, "b", 1, 3), dims("a"), dims("b"), 4.0).select("a", "b")


def _knn(fn: str, name: str) -> str:
    return f"SELECT vec_id, round({fn}(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS {name} FROM embeddings ORDER BY {fn}(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 10"


@query("knn_l2", "SE-05 ST-05 SRC-13", _knn("list_distance", "distance"))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    q = e.where("vec_id = 7").head().embedding
    return search.nearest(e, q, 10).select("vec_id", F.round("distance", 5).alias("distance"))


@query("knn_cosine", "SE-05 SE-06", _knn("list_cosine_distance", "distance"))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    q = e.where("vec_id = 7").head().embedding
    return search.nearest(e, q, 10, distance=vectors.cosine_distance).select("vec_id", F.round("distance", 5).alias("distance"))


@query("knn_of_each", "SE-05", """
SELECT query_id, id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0) WHERE rank <= 5""")
def knn_of_each(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest_of_each(queries, e, 5).select("query_id", "id", "rank")
