"""Queries over whole tables: as many rows as the table has, in order where order is the operator."""

import pytest

from ledgerloom.catalog import all_queries
from ledgerloom.sources import tables

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def rows_of(table):
    return duckdb.sql(f"select count(*) from '{FOLDER}/{table}.parquet'").fetchall()[0][0]


@pytest.mark.parametrize(("name", "table"), [("num_funcs", "events"), ("affinity_join", "orders"), ("str_case_length", "documents"), ("seed_rows", "supplier"), ("owner_check_update", "orders")])
def test_as_many_rows_as_the_table(spark, name, table):
    assert all_queries()[name].run(spark, FOLDER).count() == rows_of(table)


def test_closure_of_all_customers(spark):
    lines = duckdb.sql(f"select count(*) from (select distinct l_orderkey, l_linenumber from '{FOLDER}/lineitem.parquet')").fetchall()[0][0]
    assert all_queries()["fk_closure"].run(spark, FOLDER).count() == rows_of("customer") + rows_of("orders") + lines


@pytest.mark.parametrize("name", ["transfer_digest", "transfer_accept"])
def test_transfers_of_all_owners(spark, name):
    assert all_queries()[name].run(spark, FOLDER).count() == duckdb.sql(f"select count(distinct o_custkey) from '{FOLDER}/orders.parquet'").fetchall()[0][0]


@pytest.mark.parametrize(("name", "table"), [("order_by", "orders"), ("bytewise_sort", "customer")])
def test_whole_order(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    q = all_queries()[name]
    got = [tuple(r) for r in q.run(spark, FOLDER).collect()]
    assert len(got) == rows_of(table) and got == con.execute(q.oracle).fetchall()


def test_ledger_queries_meet_the_whole_ledger(spark, monkeypatch):
    from ledgerloom.catalog import ledgers
    from ledgerloom.ledger import replay
    from ledgerloom.streaming import events

    n, seen, paged = ledgers.ledger(spark, FOLDER).count(), [], []
    make, page = replay.Materializer._publish, events.page
    monkeypatch.setattr(replay.Materializer, "_publish", lambda self, length, *a: seen.append(length) or make(self, length, *a))
    monkeypatch.setattr(events, "page", lambda flat, log, **k: paged.append(log.count()) or page(flat, log, **k))
    assert all_queries()["ledger_final_prefix"].run(spark, FOLDER).count() == n // 4 and seen == [0, n // 2, n]
    assert all_queries()["event_cursor_checks"].run(spark, FOLDER).head().moved and set(paged) == {n}


def test_seeds_of_more_rows_than_one_may_have(spark, tmp_path):
    n, most = 20_001, tables.MAX_SEED_ROWS
    rows = spark.range(n).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = all_queries()["seed_rows"].run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, i % 25, i % 25 + 1) for i in range(n)]
    owners = rows.selectExpr("s_nationkey AS key", "s_nationkey + 1 AS id").distinct()
    for seed in (None, "half"):  # one seed alone is still refused
        with pytest.raises(ValueError, match="too_large"):
            tables.seed_rows(rows.selectExpr("*", f"s_suppkey <= {most} AS half"), owners, owner_key="s_nationkey", seed=seed)
