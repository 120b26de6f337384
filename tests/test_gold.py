import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.operators import dims, facts, setdiff
from ordermill.operators.quality import QualityError
from ordermill.operators.silver import append_silver, events_from_silver, newest_per_event, split_datetimes
from ordermill.operators.upsert import action_counts, upsert_plan
from ordermill.plans import gold
from ordermill.schemas import DIM_CUSTOMER, DIM_PRODUCT
from ordermill.sources.store import VersionedTables
from samples import bronze, event, order, silver, texts, values

TABLES = list(gold.SCHEMAS)


@pytest.fixture
def store(spark, folder):
    return VersionedTables(spark, folder("gold"))


def rows():
    return [
        *order(1),
        *order(2, customer_id="C0", product_id="P9", promo_code="FREESHIP"),
        *order(3, ["ORDER_CREATED"]),
        *order(4, ["ORDER_CREATED", "PAYMENT_CONFIRMED", "ORDER_CANCELLED", "REFUND_ISSUED"],
               category="Toys"),
        event("ORD-0001-0", "ORD-0001", hours=1),
    ]


def load(spark, store, given):
    return gold.build_gold(store, silver(spark, given), bronze(spark, given))


def inserted(report):
    return {name: c["insert"] for name, c in report.actions.items()}


def replace(store, name, frame):
    """Publish other rows for a table."""
    table = gold.parted(store).get(name)
    if table is None:
        store.stage(name, frame)
        store.publish(replaced=[name])
    else:
        _, folders = table.stage(frame)
        store.publish(parts={name: table.replaced(folders, table.keys())})


def snapshot(store):
    return {name: texts(frame) for name, frame in gold.gold_tables(store).items()}


def test_first_load(spark, store):
    report = load(spark, store, rows())
    assert report.version == 1
    assert report.source == {"events": 13, "bronze_rows": 14, "orders": 4}
    assert inserted(report) == {
        "dim_date": 1, "dim_customer": 2, "dim_product": 3, "fact_sales_events": 13, "order_states": 4
    }
    assert values(store.read("dim_customer", DIM_CUSTOMER)) == {(1, "C0"), (2, "C1")}
    assert values(store.read("dim_product", DIM_PRODUCT)) == {
        (1, "P1", "Books"), (2, "P1", "Toys"), (3, "P9", "Books")
    }
    assert values(gold.load_counts(store)) == {
        ("dim_date", 1), ("dim_customer", 2), ("dim_product", 3), ("fact_sales_events", 13),
        ("fact_orders", 4),
    }
    exported = gold.exported_tables(store)
    metrics = exported["order_payment_metrics"][0]
    assert values(metrics, "order_id", "gross_paid_vnd", "refunded_vnd", "net_paid_vnd") == {
        (f"ORD-000{n}", Decimal(g), Decimal(r), Decimal(g) - Decimal(r))
        for n, g, r in [(1, "200.00", "0.00"), (2, "200.00", "0.00"), (3, "0.00", "0.00"), (4, "200.00", "200.00")]
    }
    again = facts.order_payment_metrics(exported["fact_orders"][0], exported["fact_sales_events"][0])
    assert setdiff.bag_diff(metrics, again).count() == 0
    day = store.read("dim_date", gold.SCHEMAS["dim_date"]).first()
    assert (day.date_key, day.date_label, day.day_of_week, day.is_weekend) == (20260829, "20262908", 6, True)


def test_second_load_changes_nothing(spark, store):
    load(spark, store, rows())
    before = snapshot(store)
    report = load(spark, store, rows())
    assert report.version == 1 and not report.changed
    assert snapshot(store) == before
    pending = gold.pending_changes(store, silver(spark, rows()))
    assert all(c["insert"] == c["update"] == c["stale"] == 0 for c in pending.values())
    assert gold.unchanged(store, silver(spark, rows()))
    assert not gold.unchanged(store, silver(spark, [*rows(), *order(5)]))


@pytest.mark.parametrize("name", ["dim_date", "fact_sales_events", "order_states"])
def test_wrong_values_are_repaired(spark, store, name):
    load(spark, store, rows())
    before = snapshot(store)
    column = {"dim_date": "date_label"}.get(name, "promo_code")
    for wrong in (F.lit("wrong"), F.lit(None).cast("string")):
        damaged = store.read(name, gold.SCHEMAS[name]).withColumn(column, wrong)
        replace(store, name, damaged)
        report = load(spark, store, rows())
        assert report.actions[name]["update"] > 0
        assert [n for n, c in report.actions.items() if c["insert"] or c["update"]] == [name]
        assert snapshot(store) == before


def fact_files(store):
    return {n: sorted(t.appended_rows().inputFiles()) for n, t in gold.parted(store).items()}


def test_an_unchanged_load_writes_no_file(spark, store, monkeypatch):
    load(spark, store, rows())
    files, staged = fact_files(store), []
    monkeypatch.setattr(gold.PartedTable, "stage", lambda *a: staged.append(a))
    report = load(spark, store, rows())
    assert not staged and fact_files(store) == files
    assert report.actions["fact_sales_events"] == {"insert": 0, "update": 0, "same": 13, "stale": 0}
    assert report.actions["order_states"] == {"insert": 0, "update": 0, "same": 4, "stale": 0}


def test_only_differing_parts_are_written(spark, store):
    given = [*rows(), event("Z", "ORD-0020", hours=24 * 70)]
    load(spark, store, given)
    files = fact_files(store)
    known = store.read("fact_sales_events", gold.SCHEMAS["fact_sales_events"])
    replace(store, "fact_sales_events", known.withColumn("city", F.when(F.col("event_id") == "Z", None).otherwise(F.col("city"))))
    before = fact_files(store)["fact_sales_events"]
    report = load(spark, store, given)
    assert report.actions["fact_sales_events"] == {"insert": 0, "update": 1, "same": 13, "stale": 0}
    after = fact_files(store)["fact_sales_events"]
    assert len(set(before) & set(after)) == len(before) - 1 and fact_files(store)["order_states"] == files["order_states"]


def test_an_event_that_moved_to_another_month_is_an_update(spark, store):
    load(spark, store, rows())
    known = store.read("fact_sales_events", gold.SCHEMAS["fact_sales_events"])
    moved = F.when(F.col("event_id") == "ORD-0003-0", F.lit(20250101)).otherwise(F.col("event_date_key"))
    replace(store, "fact_sales_events", known.withColumn("event_date_key", moved))
    report = load(spark, store, rows())
    assert report.actions["fact_sales_events"] == {"insert": 0, "update": 1, "same": 12, "stale": 0}
    assert event_months(store) == ["202608"]


def event_months(store):
    return gold.event_parts(store).keys()


@pytest.mark.parametrize("times", [1, 10])
def test_a_batch_opens_files_of_its_buckets_only(spark, store, folder, monkeypatch, times):
    path = folder("silver")
    many = [event(f"E{k}", f"ORD-{k:05d}", hours=k % 50) for k in range(40 * times)]
    stored = append_silver(spark, split_datetimes(newest_per_event(bronze(spark, many))), path)
    gold.refresh_gold(store, stored, bronze(spark, many))
    batch = [event("NEW", "ORD-00007", "PAYMENT_CONFIRMED", hours=7.5)]
    stored = append_silver(spark, split_datetimes(newest_per_event(bronze(spark, batch))), path)
    opened, read = [], gold.PartedTable.appended_rows

    def watched(self, keys=None):
        rows = read(self, keys)
        opened.extend((self.name, f) for f in rows.inputFiles())
        return rows

    table = gold.state_parts(store)
    bucket = table.with_key(spark.createDataFrame([("ORD-00007",)], "order_id string")).first()[1]
    every = set(table.appended_rows().inputFiles())
    monkeypatch.setattr(gold.PartedTable, "appended_rows", watched)
    gold.refresh_gold(store, stored, bronze(spark, batch))
    states = {f for n, f in opened if n == "order_states" and f in every}
    events = {f for n, f in opened if n == "fact_sales_events"}
    assert states and all(f"_part={bucket}/" in f for f in states) and len(states) < len(every) / 4
    assert events and all("_part=202608/" in f for f in events)


def test_conflict_inside_a_batch_is_found(spark, store, folder):
    batch = [event("A"), event("B", event_type="PAYMENT_CONFIRMED", city="Hanoi")]
    stored = append_silver(spark, split_datetimes(newest_per_event(bronze(spark, batch))), folder("silver"))
    with pytest.raises(QualityError, match="order attributes conflict: 1"):
        gold.refresh_gold(store, stored, bronze(spark, batch))
    assert store.current()[0] == 0


def test_merges_keep_folders_few_and_rows_the_same(spark, folder):
    from ordermill.sources.parts import PartedTable

    store = VersionedTables(spark, folder("merged"))
    adds = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    schema = spark.createDataFrame([], "k int, n long").schema
    table = PartedTable(store, "sums", schema, F.col("k") % 3, adds)
    for turn in range(11):
        _, folders = table.stage(spark.createDataFrame([(turn, 1), (0, 1), (1, turn)], schema).groupBy("k").agg(F.sum("n").alias("n")))
        store.publish(parts={"sums": table.appended(folders)})
        table.merge(fanout=2)
        assert max(len(f) for f in store.current()[1]["sums"].values()) < 2
    assert values(table.read()) == {(0, 12), (1, 56), *[(k, 1) for k in range(2, 11)]}
    assert values(table.read(["2"])) == {(2, 1), (5, 1), (8, 1)}
    again = VersionedTables(spark, folder("merged"))
    assert values(PartedTable(again, "sums", schema, F.col("k") % 3, adds).read()) == values(table.read())


def test_stale_rows_stop_the_load(spark, store):
    load(spark, store, [*rows(), *order(5)])
    before, version = snapshot(store), store.current()
    with pytest.raises(QualityError, match="fact_sales_events: stale rows: 4"):
        load(spark, store, rows())
    assert snapshot(store) == before and store.current() == version


def test_invalid_source_publishes_nothing(spark, store):
    load(spark, store, rows())
    version = store.current()
    bad = [*rows(), event("X", "ORD-0009", quantity=0)]
    with pytest.raises(QualityError, match="quantity: 1"):
        load(spark, store, bad)
    assert store.current() == version


def test_keys_stay_when_customers_arrive(spark, store):
    load(spark, store, rows())
    more = [*rows(), *order(5, customer_id="A"), *order(6, customer_id="B", product_id="P0")]
    report = load(spark, store, more)
    assert report.version == 2
    assert inserted(report)["dim_customer"] == 2
    assert values(store.read("dim_customer", DIM_CUSTOMER)) == {
        (1, "C0"), (2, "C1"), (3, "A"), (4, "B")
    }
    assert store.read("dim_product", DIM_PRODUCT).agg(F.max("product_key")).first()[0] == 4


def test_late_arrival_does_not_change_the_latest_state(spark, store):
    name = "ORD-0007"
    delivered = event("D", name, "ORDER_DELIVERED", hours=2)
    load(spark, store, [*rows(), delivered])
    late = event("P", name, "PAYMENT_CONFIRMED", hours=1, delay=600, is_late_event=True)
    report = load(spark, store, [*rows(), delivered, late])
    assert report.actions["order_states"] == {"insert": 0, "update": 1, "same": 4, "stale": 0}
    state = gold.gold_tables(store)["order_states"].filter(F.col("order_id") == name).first()
    assert state.latest_event_type == "ORDER_DELIVERED"
    assert state.paid_at_utc is not None and state.has_payment
    trace = facts.order_trace(
        gold.gold_tables(store)["fact_sales_events"], gold.gold_tables(store)["order_states"], name
    ).collect()
    assert [r.event_type for r in trace] == ["PAYMENT_CONFIRMED", "ORDER_DELIVERED"]


def test_arrival_order_does_not_matter(spark, folder):
    given, results = rows(), []
    for seed in range(3):
        random.Random(seed).shuffle(given)
        store = VersionedTables(spark, folder(f"gold{seed}"))
        load(spark, store, given)
        results.append(snapshot(store))
    assert results[0] == results[1] == results[2]


def test_latest_event_ties(spark):
    same = [
        event("A", event_type="ORDER_CREATED", delay=1),
        event("B", event_type="PAYMENT_CONFIRMED", delay=2),
        event("C", event_type="ORDER_SHIPPED", delay=2),
    ]
    rolled = facts.order_rollup(events_from_silver(silver(spark, same)))
    assert rolled.first().latest_event_type == "ORDER_SHIPPED"


def test_batches_equal_a_full_load(spark, folder):
    """Random batches, refreshed one by one, against one load per batch of everything so far."""
    given = [*rows(), *order(5, customer_id="A")]
    given += order(7, ["PAYMENT_CONFIRMED", "ORDER_CREATED"], customer_id="Z", city="Hanoi")
    random.Random(4).shuffle(given)
    part, full = (VersionedTables(spark, folder(n)) for n in ("part", "full"))
    path, taken = folder("silver"), []
    for start in range(0, len(given), 7):
        batch = given[start : start + 7]
        taken += batch
        new = split_datetimes(newest_per_event(bronze(spark, batch)))
        stored = append_silver(spark, new, path)
        gold.refresh_gold(part, stored, bronze(spark, batch))
        gold.build_gold(full, stored, bronze(spark, taken))
        assert snapshot(part) == snapshot(full)
    again = gold.refresh_gold(part, stored, bronze(spark, batch))
    assert not again.changed


def test_refresh_refuses_a_conflicting_version(spark, store, folder):
    path = folder("silver")
    stored = append_silver(spark, split_datetimes(newest_per_event(bronze(spark, rows()))), path)
    gold.build_gold(store, stored, bronze(spark, rows()))
    version = store.current()
    changed = [event("ORD-0001-0", "ORD-0001", hours=1, city="Hanoi")]
    with pytest.raises(QualityError, match="reconciliation: 1"):
        gold.refresh_gold(store, stored, bronze(spark, changed))
    assert store.current() == version


@pytest.mark.parametrize("days", [1, 62, 63, 200])
def test_refresh_refuses_a_second_stored_copy(spark, store, folder, days):
    batch = [event(f"E{k}", f"ORD-{k:04d}", hours=24 * k) for k in range(days)]
    stored = append_silver(spark, split_datetimes(newest_per_event(bronze(spark, batch))), folder("silver"))
    other_day = split_datetimes(bronze(spark, [event("E0", "ORD-0000", hours=24 * 900)]))
    twice = stored.unionByName(other_day, allowMissingColumns=True)
    with pytest.raises(QualityError, match="reconciliation: 1"):
        gold.refresh_gold(store, twice, bronze(spark, batch))


def test_published_changes_are_visible(spark, store):
    load(spark, store, rows())
    before = gold.gold_tables(store)
    assert not any(
        c["insert"] + c["update"] + c["stale"]
        for c in gold.version_changes(before, gold.gold_tables(store)).values()
    )
    emptied = before | {"order_states": before["order_states"].limit(0)}
    assert gold.version_changes(before, emptied)["order_states"]["stale"] == 4
    renamed = before["dim_product"].withColumn("category", F.lit("TEST"))
    assert gold.version_changes(before, before | {"dim_product": renamed})["dim_product"]["update"] == 3
    extra = before["dim_customer"].union(spark.createDataFrame([(9, "TEST-NEW")], DIM_CUSTOMER))
    assert gold.version_changes(before, before | {"dim_customer": extra})["dim_customer"]["insert"] == 1


def test_upsert_actions(spark):
    target = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, None)], "k int, v string")
    source = spark.createDataFrame([(1, None), (2, None), (4, "x"), (5, "y")], "k int, v string")
    plan = upsert_plan(target, source, ["k"])
    assert values(plan) == {
        ("same", 1, None), ("update", 2, None), ("stale", 3, "b"), ("update", 4, "x"),
        ("insert", 5, "y"),
    }
    assert action_counts(plan) == {"insert": 1, "update": 2, "same": 1, "stale": 1}


def test_dense_keys_over_many_partitions(spark):
    """Keys are gap-free and in order, although the rows are numbered in many tasks."""
    count = 20000
    source = spark.range(count).select(
        F.concat(F.lit("C"), F.lpad((F.col("id") * 7919 % count).cast("string"), 6, "0")).alias("customer_id")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dim = dims.extend_dim(spark.createDataFrame([], DIM_CUSTOMER), source, *dims.CUSTOMER)
        found = dim.orderBy("customer_key").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.customer_key for r in found] == list(range(1, count + 1))
    assert [r.customer_id for r in found] == sorted(r.customer_id for r in found)


def test_calendar_spans_event_to_producer(spark):
    given = [event("A", hours=-48), event("B", delay=60 * 24 * 2)]
    events = events_from_silver(silver(spark, given))
    days = [r.date_key for r in dims.dim_date(events).orderBy("date_key").collect()]
    assert days == [20260827, 20260828, 20260829, 20260830, 20260831]
    assert dims.dim_date(events.limit(0)).count() == 0


def test_hot_keys_keep_every_row(spark):
    """A third of all rows belong to one customer and one order."""
    size = 6000
    at = F.timestamp_seconds(F.lit(1788016605) + F.col("id"))
    hot = F.col("id") % 3 == 0
    base = {c: F.lit(v) for c, v in event().items()}
    made = spark.range(size).select(
        *[
            v.alias(c)
            for c, v in (
                base
                | {
                    "event_id": F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 6, "0")),
                    "order_id": F.when(hot, "HOT").otherwise(F.concat(F.lit("O"), F.col("id").cast("string"))),
                    "customer_id": F.when(hot, "HOT").otherwise(F.concat(F.lit("C"), F.col("id").cast("string"))),
                    "event_time_utc": at,
                    "producer_time_utc": at,
                    "promo_code": F.lit(None).cast("string"),
                }
            ).items()
        ]
    )
    customers = dims.extend_dim(spark.createDataFrame([], DIM_CUSTOMER), made, *dims.CUSTOMER)
    products = dims.extend_dim(spark.createDataFrame([], DIM_PRODUCT), made, *dims.PRODUCT)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert facts.event_facts(made, customers, products).count() == size
        states = facts.order_states(made, customers)
        assert states.count() == 1 + size * 2 // 3
        latest = states.filter("order_id = 'HOT'").select(F.unix_seconds("latest_event_at_utc")).first()[0]
        assert latest == 1788016605 + size - 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
