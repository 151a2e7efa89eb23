"""Row numbers over several partitions, and what stands on them, at a size where ranges matter."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import all_queries
from ledgerloom.operators import windows, writes

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.1"


@pytest.fixture
def partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda n, adaptive: [spark.conf.set(k, v) for k, v in zip(names, (str(n), adaptive), strict=True)]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize(("n", "table", "order"), [(3, "events", ["ts", "user_id", "event_id"]), (16, "events", ["ts", "user_id", "event_id"]), (8, "lineitem", ["l_shipdate", "l_orderkey", "l_linenumber"])])
def test_written_numbers_are_whole(spark, partitions, tmp_path, n, table, order, adaptive):
    """All columns, written out: as many rows as numbers, 1 to n, in the order."""
    partitions(n, adaptive)
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").withColumn("copy", F.lit("x" * 50))
    writes.with_row_ids(rows, order, 0, "id").write.parquet(f"{tmp_path}/out")
    out = duckdb.sql(f"select count(*), count(distinct id), min(id), max(id) from '{tmp_path}/out/*.parquet'").fetchall()[0]
    size = duckdb.sql(f"select count(*) from '{FOLDER}/{table}.parquet'").fetchall()[0][0]
    assert out == (size, size, 1, size)
    keys = ", ".join(order)
    wrong = duckdb.sql(f"select count(*) from (select ({keys}) < lag(({keys})) over (order by id) as back from '{tmp_path}/out/*.parquet') where back").fetchall()[0][0]
    assert wrong == 0


@pytest.mark.parametrize("name", ["ledger_order", "ledger_replay_balance", "ledger_replay_state", "event_flatten", "projection_counts", "principal_ids", "win_rank_of_groups"])
def test_at_a_size_of_many_partitions(spark, partitions, name):
    partitions(8, "true")
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    q = all_queries()[name]
    df = q.run(spark, FOLDER)
    columns = sorted(df.columns)
    wanted = con.execute(f"select {', '.join(columns)} from ({q.oracle})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, wanted))


def test_rank_of_all_rows(spark, partitions):
    partitions(5, "true")
    rows = spark.createDataFrame([(i, i // 7 if i % 11 else None) for i in range(500)], "i long, k long").repartition(4)
    got = {r.i: r.r for r in windows.with_global_rank(rows, ["k"], "r").collect()}
    keys = [i // 7 if i % 11 else None for i in range(500)]
    assert got == {i: 1 + sum((k is not None, k or 0) < (keys[i] is not None, keys[i] or 0) for k in keys) for i in range(500)}
