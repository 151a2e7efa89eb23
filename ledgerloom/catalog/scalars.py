"""Scalar functions: text, numbers, nulls, dates, JSON, vectors, keys and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog._registry import Registry
from ledgerloom.functions import dates, json_values, scalars, values, vectors
from ledgerloom.sources.tables import read_table

REGISTRY = Registry()
sql, query = REGISTRY.sql, REGISTRY.query


@query("str_case_length", "FN-STR", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low FROM documents")
def str_case_length(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.char_length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.sha2(scalars.ascii_lower(t), 256).alias("low"))


sql("str_parts", "FN-STR", "SELECT c_custkey, substr(c_name, 3, 5) AS part, instr(c_name, '0') AS at, replace(c_name, 'C', 'K') AS swapped, trim('  ' || c_mktsegment || ' ') AS t, ltrim('  x') AS l, rtrim('x  ') AS r, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'z') AS joined FROM customer")


@query("substr_edges", "FN-STR", "SELECT c_custkey, substr(c_name, 1, 1) AS zero_two, right(c_name, 3) AS last_three, substr(c_name, 2, 2) AS left_of, '' AS none FROM customer")
def substr_edges(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    return read_table(spark, d, "customer").select("c_custkey", scalars.substr(n, 0, 2).alias("zero_two"), scalars.substr(n, -3).alias("last_three"), scalars.substr(n, 4, -2).alias("left_of"), scalars.substr(n, 100, 5).alias("none"))


sql("hex_text", "FN-STR FN-BLOB", "SELECT c_custkey, hex(c_mktsegment) AS h FROM customer")


@query("printf_format", "FN-STR", "SELECT o_orderkey, printf('%05d|%s|%.2f', o_orderkey, o_orderstatus, o_totalprice) AS line FROM orders")
def printf_format(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", F.format_string("%05d|%s|%.2f", "o_orderkey", "o_orderstatus", "o_totalprice").alias("line"))


@query("char_unicode_quote", "FN-STR", "SELECT c_custkey, ascii(c_name) AS code, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS letter, '''' || replace(c_name || '''', '''', '''''') || '''' AS quoted FROM customer")
def char_unicode_quote(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    return read_table(spark, d, "customer").select("c_custkey", scalars.unicode_of(n).alias("code"), F.char((F.col("c_custkey") % 26 + 65)).alias("letter"), scalars.quote(F.concat(n, F.lit("'"))).alias("quoted"))


@query("soundex_unhex", "FN-STR")
def soundex_unhex(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select("n_nationkey", scalars.soundex(F.col("n_name")).alias("s"), F.unhex(F.hex("n_name")).cast("string").alias("back"))


@query("blobs", "FN-BLOB", "SELECT n_nationkey, repeat('00', n_nationkey) AS zeros, 32 AS n FROM nation")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read_table(spark, d, "nation").select(k, F.hex(scalars.zeroblob(k)).alias("zeros"), F.octet_length(scalars.seeded_blob(k, 32)).alias("n"))


sql("num_funcs", "FN-NUM", "SELECT event_id, abs(value - 50) AS a, CAST(sign(value - 50) AS DOUBLE) AS s, round(value, 1) AS r FROM events")


@query("num_minmax", "FN-NUM", "SELECT o_orderkey, CASE WHEN nullif(o_custkey % 5, 0) IS NULL THEN NULL ELSE greatest(o_custkey % 5, 2) END AS mx, CASE WHEN nullif(o_custkey % 5, 0) IS NULL THEN NULL ELSE least(o_custkey % 5, 2) END AS mn, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 5) END AS q FROM orders")
def num_minmax(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_custkey") % 5
    x = F.nullif(m, F.lit(0))
    return read_table(spark, d, "orders").select("o_orderkey", scalars.scalar_max(x, F.lit(2)).alias("mx"), scalars.scalar_min(x, F.lit(2)).alias("mn"), scalars.int_div(F.col("o_orderkey"), m).alias("q"))


@query("seeded_random", "FN-NUM FN-08", "SELECT count(*) AS n, true AS same FROM events")
def seeded_random(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.bool_and(scalars.seeded_random(F.col("event_id"), F.lit(1)) == scalars.seeded_random(F.col("event_id"), F.lit(1))).alias("same"))


@query("overflow_to_real", "PRJ-13 AG-02", "SELECT o_orderkey, CAST(o_orderkey + 1 AS VARCHAR) AS small FROM orders")
def overflow_to_real(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", scalars.add_or_real(F.col("o_orderkey"), F.lit(1).cast("long")).alias("small"))


sql("null_funcs", "FN-NULL FN-TYPE", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, ifnull(nullif(o_orderstatus, 'O'), '-') AS i, nullif(o_custkey, 1) AS n, if(o_totalprice > 1000, 'y', 'n') AS f FROM orders")


@query("date_funcs", "FN-DATE FN-08", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s,
       strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, round(epoch_us(ts) // 1000 / 86400000.0 + 2440587.5, 2) AS jd, strftime(ts, '%Y/%j') AS yj FROM events""")
def date_funcs(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return read_table(spark, d, "events").select("event_id", dates.datetime(ms).alias("dt"), dates.date(ms).alias("d"), dates.time(ms).alias("t"), dates.unixepoch(ms).alias("s"), dates.date(ms, "start of month").alias("month"), dates.datetime(ms, "+36 hours").alias("later"), F.round(dates.julianday(ms), 2).alias("jd"), dates.strftime("%Y/%j", ms).alias("yj"))


@query("date_rollover", "FN-DATE", "SELECT '2024-03-02' AS rolled, '2024-02-29' AS day, '2024-02-05' AS monday, '+0001 01:00:00' AS diff")
def date_rollover(spark: SparkSession, d: str) -> DataFrame:
    jan31 = F.lit(1706659200000)
    return spark.range(1).select(dates.date(jan31, "+1 month").alias("rolled"), dates.date(jan31, "+29 days").alias("day"), dates.date(jan31, "weekday 1").alias("monday"), dates.timediff(jan31 + 90_000_000, jan31).alias("diff"))


@query("json_extract", "FN-JSON SRC-08", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS ok, json_type(props) = 'OBJECT' AS object FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return read_table(spark, d, "events").select("event_id", json_values.extract(p, "$.k").cast("long").alias("k"), json_values.valid(p).alias("ok"), (json_values.type_of(p) == "object").alias("object"))


@query("json_each_rows", "SRC-08 FN-JSON", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_each_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.explode(json_values.each(F.col("props"))).alias("e")).select("event_id", "e.key", "e.value")


@query("json_tree_rows", "SRC-09", "SELECT event_id, '$' AS fullkey, 'object' AS type, NULL AS atom FROM events UNION ALL SELECT event_id, '$.k', 'integer', json_extract_string(props, '$.k') FROM events")
def json_tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.explode(json_values.tree(F.col("props"))).alias("n")).select("event_id", "n.fullkey", "n.type", "n.atom")


@query("json_changes", "FN-JSON", """
SELECT event_id, '{"k":0}' AS setting, '{"k":' || json_extract_string(props, '$.k') || ',"x":[1]}' AS inserted, '{}' AS removed, '{"k":' || json_extract_string(props, '$.k') || ',"y":true}' AS patched FROM events""")
def json_changes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return read_table(spark, d, "events").select("event_id", json_values.replace_value(p, "$.k", F.lit("0")).alias("setting"), json_values.insert_value(p, "$.x", F.lit("[1]")).alias("inserted"), json_values.remove_value(p, "$.k").alias("removed"), json_values.patch(p, F.lit('{"y":true}')).alias("patched"))


sql("json_array_length", "FN-JSON", "SELECT r_regionkey, json_array_length('[1,2,' || r_regionkey || ']') AS n FROM region", "SELECT r_regionkey, CAST(json_array_length('[1,2,' || r_regionkey || ']') AS INTEGER) AS n FROM region")


@query("vector_distances", "FN-VEC SE-06", """
SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS l2, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine,
       round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS dot FROM embeddings a JOIN (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b ON true""")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    v, q = F.col("embedding"), F.col("q")
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(vectors.l2(v, q), 5).alias("l2"), F.round(vectors.cosine_distance(v, q), 5).alias("cosine"), F.round(vectors.dot(v, q), 5).alias("dot"))


@query("vector_arithmetic", "FN-VEC", """
SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + x)), 4) AS doubled, 0.0 AS zero, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS bits, CAST(list_sum(list_transform(embedding[3:6], lambda x: CAST(x > 0 AS INTEGER))) AS BIGINT) AS part FROM embeddings""")
def vector_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    bits = vectors.quantize_binary(v)
    return read_table(spark, d, "embeddings").select("vec_id", F.round(total(vectors.add(v, v)), 4).alias("doubled"), total(vectors.subtract(v, v)).alias("zero"), count(bits).alias("bits"), count(vectors.slice_of(bits, 2, 6)).alias("part"))


@query("vector_others", "FN-VEC", "SELECT vec_id, 0.0 AS self, 0 AS h, len(embedding) AS n, 0.0 AS l1, len(embedding) AS parsed FROM embeddings")
def vector_others(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return read_table(spark, d, "embeddings").select("vec_id", F.round(vectors.l2(vectors.normalize(v), vectors.normalize(v)), 6).alias("self"), vectors.hamming(vectors.quantize_binary(v), vectors.quantize_binary(v)).alias("h"), F.size(vectors.quantize_int8(v)).alias("n"), F.round(vectors.l1(v, v), 6).alias("l1"), F.size(F.from_json(vectors.to_json(v), "array<double>")).alias("parsed"))


@query("row_key", "FN-05", """
SELECT o_orderkey, 'rk1:0002' || '01' || lpad(lower(hex(o_orderkey)), 16, '0') || coalesce('03' || lpad(lower(hex(strlen(nullif(o_orderstatus, 'P')))), 8, '0') || lower(hex(nullif(o_orderstatus, 'P'))), '00') AS k FROM orders""")
def row_key(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", values.row_key_column([(F.col("o_orderkey"), "integer"), (F.nullif("o_orderstatus", F.lit("P")), "text")]).alias("k"))


@query("value_equal", "FN-06", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM nullif('P', 'P') AS eq FROM orders")
def value_equal(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", values.value_equal(F.nullif("o_orderstatus", F.lit("P")), F.lit(None).cast("string")).alias("eq"))


@query("assert_all", "FN-01", "SELECT count(*) AS n FROM orders")
def assert_all(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(scalars.affirm(F.col("o_orderkey").isNotNull(), "key").alias("ok")).agg(F.sum("ok").cast("long").alias("n"))


sql("engine_version", "FN-VER", "SELECT length(version()) > 0 AS has_version")
