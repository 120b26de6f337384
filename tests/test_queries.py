"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from ordermill import catalog, oracle
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
ORACLES = oracle.statements()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    frame = QUERIES[name](spark, SF)
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                   "MapInPandas", "SinglePartition, REPARTITION"):
        assert costly not in plan


def test_a_streamed_table_may_be_a_folder(spark, folder):
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(folder("events.parquet"))
    name = "streamed_window_counts"
    one, many = QUERIES[name](spark, SF), QUERIES[name](spark, folder("").rstrip("/"))
    assert rows_of(one.columns, one.collect()) == rows_of(many.columns, many.collect())


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "full_date", "gross_paid", "net_paid", "paid_orders", "refunded_amount"
    ]
