"""Encodings, functions at their edges, the policy and its limits."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import dates, json_values, scalars, values, vectors
from ledgerloom.operators import recursion, search, writes
from ledgerloom.plans import policy
from ledgerloom.plans.definitions import Schema
from ledgerloom.plans.session import Session
from ledgerloom.streaming import signals

VALUES = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text(), st.binary())


@given(st.lists(VALUES, min_size=1, max_size=5), st.lists(VALUES, min_size=1, max_size=5))
def test_row_keys_are_equal_only_for_equal_tuples(a, b):
    equal = len(a) == len(b) and all(values.storage_equal(x, y) for x, y in zip(a, b, strict=True))
    assert (values.row_key(a) == values.row_key(b)) == equal


def test_row_key_column_equals_row_key(spark):
    rows = [(1, 1.0, "é\0", b"\x01"), (-5, -0.0, "", b""), (None, None, None, None), (2**63 - 1, 1e300, "x", b"\xff" * 3)]
    df = spark.createDataFrame(rows, "i long, r double, t string, b binary")
    key = values.row_key_column([(F.col("i"), "integer"), (F.col("r"), "real"), (F.col("t"), "text"), (F.col("b"), "blob")])
    assert sorted(r.k for r in df.select(key.alias("k")).collect()) == sorted(values.row_key(list(r)) for r in rows)


def test_values_that_cant_be_bound():
    assert values.bind_value(True) == 1 and values.row_key([1]) != values.row_key([1.0])
    for v in (2**63, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            values.bind_value(v)
    with pytest.raises(TypeError):
        values.bind_value(object())
    assert struct.pack(">d", 0.0) != struct.pack(">d", -0.0) and not values.storage_equal(0.0, -0.0)


def test_scalar_edges(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).head().x
    assert [get(scalars.cast_integer(F.lit(t))) for t in ("12abc", " -7", "x", "")] == [12, -7, 0, 0]
    assert [get(scalars.substr(F.lit("abcdef"), s, n)) for s, n in ((0, 2), (-3, 2), (2, None), (4, -2), (1, 0))] == ["a", "de", "bcdef", "bc", ""]
    assert get(scalars.like(F.lit("aXB%"), "A_b!%", "!")) and not get(scalars.like(F.lit("É"), "é"))
    assert get(scalars.glob(F.lit("a]b"), "a[]x]b")) and not get(scalars.glob(F.lit("A"), "a")) and get(scalars.glob(F.lit("x.y"), "x.[^z]"))
    assert get(scalars.int_div(F.lit(-7), F.lit(2))) == -3 and get(scalars.int_mod(F.lit(7), F.lit(0))) is None
    assert get(scalars.unicode_of(F.lit("é"))) == 233 and get(scalars.quote(F.lit(None).cast("string"))) == "NULL"
    assert get(scalars.soundex(F.lit("12"))) == "?000"
    assert get(dates.datetime(F.lit(0), "start of year", "-1 day")) == "1969-12-31 00:00:00"
    assert get(dates.strftime("%Y%%%w", F.lit(0))) == "1970%4"
    with pytest.raises(ValueError):
        dates.date(F.lit(0), "next week")
    assert get(json_values.set_value(F.lit('{"a":[1]}'), "$.a[1]", F.lit('"x"'))) == '{"a":[1,"x"]}'
    assert get(json_values.set_value(F.lit("no json"), "$.a", F.lit("1"))) is None
    assert get(vectors.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_canonical_json_has_bounds():
    assert json_values.canonical({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    deep = 1
    for _ in range(40):
        deep = [deep]
    for bad in (deep, ["x" * 20_000], [float("nan")], list(range(5000))):
        with pytest.raises(ValueError):
            json_values.canonical(bad)


@pytest.mark.parametrize("text", ["SELECT 1; DROP TABLE t", "DELETE FROM t", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1", "SELECT ReFlEcT ('a')", "SELECT `uuid`()", "SET x = 1", "SELECT 1\0"])
def test_denied(text):
    with pytest.raises(policy.Rejected):
        policy.check_statement(text, policy.Mode.LOCAL_READ)


@settings(max_examples=50)
@given(st.text(max_size=40))
def test_tokens_cover_the_text(text):
    at = 0
    for t in policy.tokens(text):
        assert t.start >= at and text[t.start : t.start + len(t.text)] == t.text
        at = t.start + len(t.text)


def test_session_reads(spark):
    s = Session(spark, "/root/testdata/sf0.001")
    assert s.rows("SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", [1])[0].n == 5
    for text, code in (("SELECT * FROM nowhere", "prepare"), ("SELECT assert_true(false)", "error"), ("SELECT l_orderkey FROM lineitem a, region b", "too_large")):
        with pytest.raises(policy.Rejected) as e:
            s.rows(text)
        assert e.value.code == code or text.startswith("SELECT assert")
    with pytest.raises(policy.Rejected):
        s.query("none", {})


def test_input_schemas():
    schema = Schema({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer", "maximum": 3}, "maxItems": 2}}, "required": ["a"]})
    schema.validate({"a": [1, 3]})
    for bad in ({}, {"a": [4]}, {"a": [1, 1, 1]}, {"a": [True]}, {"a": [], "b": 1}, []):
        with pytest.raises(policy.Rejected):
            schema.validate(bad)
    with pytest.raises(ValueError):
        Schema({"type": "object", "pattern": "x"})


def test_graphs_and_recursion(spark):
    assert recursion.ancestry({"c": "b", "b": "a", "a": None}, "c") == ["c", "b", "a"]
    for parents in ({"a": "b", "b": "a"}, {"a": "z"}):
        with pytest.raises(ValueError):
            recursion.ancestry(parents, "a")
    with pytest.raises(ValueError):
        recursion.parents_first({"a": ["b"], "b": ["a"]})
    assert recursion.parents_first({"a": ["a"], "b": ["a"]}) == ["a", "b"]
    with pytest.raises(recursion.StepLimit):
        recursion.fixpoint(spark.createDataFrame([(1,)], "k long"), lambda new: new.select((F.col("k") + 1).alias("k")), max_rounds=2)


def test_writes_with_ties_and_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(writes.replace(t, new, ["k"], ["o"])) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(writes.insert_or_ignore(t, new, ["k"], ["o"])) == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(writes.delete(t, F.lit(None).cast("boolean"))) == rows(t)
    assert rows(writes.with_row_ids(spark.createDataFrame([(5,), (5,), (1,)], "k int"), ["k"], 10, "id")) == [(1, 11), (5, 12), (5, 13)]


def test_signal_bounds(spark):
    rows = spark.createDataFrame([("a", "s", i, "t", "x" * 10, i, i + 30_000) for i in range(70)], "author string, session string, sequence int, topic string, payload string, issued_ms long, expires_ms long")
    with pytest.raises(signals.Overflow):
        signals.take_all(rows, "author")
    assert signals.alive(rows, 30_010).count() == 59
    assert signals.latest(rows).head().sequence == 69


def test_phrases_and_boxes(spark):
    index = search.postings(spark.createDataFrame([(1, "to be or not to be"), (2, "be to"), (3, None)], "doc_id int, text string"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(search.match_phrase(index, ["to", "be"])) == [1]
    assert ids(search.match_phrase(index, ["be", "or", "not"])) == [1]
    assert ids(search.match_near(index, "or", "be", 0)) == [1]
    box = spark.createDataFrame([(1, 0.0, 10.0), (2, 20.0, 21.0)], "a int, x0 double, x1 double")
    other = spark.createDataFrame([(7, 10.0, 30.0)], "b int, u0 double, u1 double")
    assert sorted((r.a, r.b) for r in search.overlaps(box, other, [("x0", "x1")], [("u0", "u1")], 3.0).collect()) == [(1, 7), (2, 7)]
