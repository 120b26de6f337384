"""Event facts: the keys of stored rows, and how often whole rows are shuffled."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ordermill import catalog, session
from ordermill.operators import facts
from ordermill.schemas import BRONZE, FACT_SALES_EVENTS_COLUMNS

CUSTOMERS = "customer_key long, customer_id string"
PRODUCTS = "product_key long, product_id string, category string"


@pytest.fixture
def tables(spark):
    events = []
    for k in range(60):
        row = dict.fromkeys(BRONZE.names)
        row |= {"event_id": f"E{k}", "order_id": f"O{k // 4}", "event_type": "ORDER_CREATED"}
        row["customer_id"] = None if k == 7 else f"C{k % 5}"
        row["product_id"], row["category"] = f"P{k % 3}", None if k == 11 else "A"
        row["event_time_utc"] = None if k == 13 else datetime(2026, 1, 1 if k < 50 else k % 4 + 2, 8)
        events.append(tuple(row[c] for c in BRONZE.names))
    events += events[:3]  # rows may repeat
    customers = [(k, f"C{k}") for k in range(4)] + [(9, "C1")]  # C4 is unknown, C1 is there twice
    products = [(k, f"P{k}", "A") for k in range(3)]
    return (
        spark.createDataFrame(events, BRONZE),
        spark.createDataFrame(customers, CUSTOMERS),
        spark.createDataFrame(products, PRODUCTS),
    )


@pytest.fixture
def conf(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum", "spark.sql.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    yield spark.conf
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def expected(events, customers, products):
    joined = events.join(customers, "customer_id").join(products, ["product_id", "category"])
    key = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    joined = joined.withColumns({"event_date_key": key("event_time_utc"), "producer_date_key": key("producer_time_utc")})
    return sorted(map(str, joined.select(*FACT_SALES_EVENTS_COLUMNS).collect()))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("per_task", [1_000_000, 6])
def test_stored_facts_are_the_joined_rows(spark, tables, conf, folder, monkeypatch, threshold, per_task):
    conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.setattr(facts, "ROWS_PER_PARTITION", per_task)
    schema = facts.write_event_facts(*tables, folder("facts"))
    stored = spark.read.schema(schema).parquet(folder("facts"))
    assert sorted(map(str, stored.collect())) == expected(*tables)
    assert sorted(map(str, facts.event_facts(*tables).collect())) == expected(*tables)


def test_no_events(spark, tables, folder):
    events, customers, products = tables
    schema = facts.write_event_facts(events.limit(0), customers, products, folder("none"))
    assert spark.read.schema(schema).parquet(folder("none")).count() == 0


def test_whole_rows_are_shuffled_once(tables, conf):
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = facts.event_facts(*tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows and their keys


def test_shuffles_follow_the_rows(spark, conf, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 10)
    conf.set("spark.sql.shuffle.partitions", "4")
    session.enough_partitions(spark, 95)
    assert conf.get("spark.sql.shuffle.partitions") == "10"
    assert conf.get("spark.sql.files.minPartitionNum") == "10"
    session.enough_partitions(spark, 5)
    assert conf.get("spark.sql.shuffle.partitions") == "10"


def test_numbers_that_nobody_has_set_are_those_of_spark(spark, conf, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 10)
    conf.unset("spark.sql.shuffle.partitions")
    conf.unset("spark.sql.files.minPartitionNum")
    usual = int(conf.get("spark.sql.shuffle.partitions"))
    session.enough_partitions(spark, 10 * usual - 1)
    assert conf.get("spark.sql.shuffle.partitions", None) is None
    assert conf.get("spark.sql.files.minPartitionNum") == str(usual)
    session.enough_partitions(spark, 10 * usual)
    assert conf.get("spark.sql.shuffle.partitions") == str(usual + 1)


@pytest.mark.parametrize("name", ["affected_orders", "bronze_csv", "dim_extend", "exported_metrics"])
def test_queries_in_a_session_that_names_no_partitions(spark, conf, folder, name):
    orders = [(k, k % 3, datetime(1996, 1, 1 + k % 28)) for k in range(300)]
    parts = [(k, f"T{k % 2}", 10.0 + k) for k in range(7)]
    found = []
    for number in (None, "4"):
        conf.set("spark.sql.shuffle.partitions", number) if number else conf.unset("spark.sql.shuffle.partitions")
        tables = folder(f"tables-{number}")  # stored layers are found by this path
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tables}/orders.parquet")
        spark.createDataFrame(parts, "p_partkey long, p_type string, p_retailprice double").write.parquet(f"{tables}/part.parquet")
        found.append(sorted(map(str, catalog.QUERIES[name](spark, tables).collect())))
    assert found[0] == found[1] != []
