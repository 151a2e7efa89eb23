"""Every registered query against its DuckDB statement, at the smallest size."""

import decimal
import math

import pytest

from ledgerloom.catalog import all_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = all_queries()


def same(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_statement(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    if q.oracle is None:
        assert got
        return
    result = duck.execute(q.oracle)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted(repr([same(r[i]) for i in at]) for r in result.fetchall())
    # repr of 1 and 1.0 differ only where the engines' numeric types do
    number = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
    assert number(got) == number(wanted)
