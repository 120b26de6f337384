from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.operators import facts, quality
from ordermill.operators.silver import decode_inbox, events_from_silver
from ordermill.sources.inbox import as_inbox_rows
from samples import bronze, event, message, messages, order, silver, values

BREAKS = {
    "required id": {"customer_id": "' C1'"},
    "event or producer time": {"producer_time_utc": "cast(null as string)"},
    "quantity": {"quantity": "cast(null as int)"},
    "unit price": {"unit_price_vnd": "cast(-1 as decimal(18,2))"},
    "order total": {"order_total_vnd": "cast(null as decimal(18,2))"},
    "late flag": {"is_late_event": "cast(null as boolean)"},
    "producer before event": {"producer_date_utc": "'20252908'"},
    "event type": {"event_type": "'ORDER_LOST'"},
    "date text": {"loaded_time_utc": "cast(null as string)"},
    "impossible date": {"loaded_date_utc": "'20263102'"},
}


def damaged(frame, changes, event_id="ORD-0001-1"):
    at = F.col("event_id") == event_id
    return frame.withColumns({c: F.when(at, F.expr(v)).otherwise(F.col(c)) for c, v in changes.items()})


@pytest.fixture(scope="module")
def good(spark):
    rows = [*order(1), *order(2, ["ORDER_CREATED"]), event("ORD-0001-0", "ORD-0001", hours=1)]
    return silver(spark, rows), bronze(spark, rows)


def test_pass_report(good):
    report = quality.require_source(*good)
    assert report == {"events": 5, "bronze_rows": 6, "orders": 2}
    assert quality.silver_violations(good[0]).count() == 0


@pytest.mark.parametrize("rule", BREAKS)
def test_each_rule_is_named(good, rule):
    bad = damaged(good[0], BREAKS[rule])
    found = quality.silver_violations(bad).collect()
    assert [r.event_id for r in found] == ["ORD-0001-1"] and rule in found[0].rules
    with pytest.raises(quality.QualityError, match=rule):
        quality.require_source(bad, good[1])


@pytest.mark.parametrize("value", [None, "", " ", "NULL", "x "])
@pytest.mark.parametrize(
    "column", ["order_id", "event_type", "customer_id", "product_id", "category"]
)
def test_ids(good, column, value):
    bad = damaged(good[0], {column: "cast(null as string)" if value is None else f"'{value}'"})
    assert "required id" in quality.silver_violations(bad).first().rules


def test_impossible_event_date(good):
    bad = damaged(good[0], {"event_date_utc": "'20263102'"})
    with pytest.raises(quality.QualityError, match="impossible date"):
        quality.require_source(bad, good[1])


def test_empty_silver(good):
    with pytest.raises(quality.QualityError, match="empty Silver"):
        quality.require_source(good[0].limit(0), good[1].limit(0))


def test_duplicate_silver_row(good):
    with pytest.raises(quality.QualityError, match="duplicate event_id: 1"):
        quality.require_source(good[0].union(good[0].limit(1)), good[1])


def test_missing_silver_row(good):
    with pytest.raises(quality.QualityError, match="reconciliation: 1"):
        quality.require_source(good[0].filter("event_id <> 'ORD-0001-1'"), good[1])


def test_missing_bronze_row(good):
    with pytest.raises(quality.QualityError, match="reconciliation: 1"):
        quality.require_source(good[0], good[1].filter("event_id <> 'ORD-0001-1'"))


def test_changed_value(good):
    with pytest.raises(quality.QualityError, match="reconciliation: 1"):
        quality.require_source(damaged(good[0], {"city": "'Hanoi'"}), good[1])


def test_conflicting_bronze_versions(spark, good):
    other = bronze(spark, [event("ORD-0001-1", "ORD-0001", "PAYMENT_CONFIRMED", 2, city="Hanoi")])
    both = good[1].union(other)
    assert values(quality.bronze_conflicts(both)) == {("ORD-0001-1",)}
    assert quality.bronze_conflicts(good[1]).count() == 0
    with pytest.raises(quality.QualityError, match="conflicting Bronze versions: 1"):
        quality.require_source(good[0], both)


def test_promo_forms_are_equal(spark, good):
    same = good[1].withColumn("promo_code", F.lit(" null "))
    assert quality.require_source(good[0], same)["events"] == 5


@pytest.mark.parametrize(
    "change", [{"customer_id": "C2"}, {"promo_code": "X"}, {"order_total_vnd": Decimal("1.00")}]
)
def test_order_attributes(spark, change):
    rows = order(1)
    rows[2] |= change
    events = events_from_silver(silver(spark, rows + order(2)))
    assert values(quality.order_attribute_conflicts(events)) == {("ORD-0001",)}
    with pytest.raises(quality.QualityError, match="order attributes conflict: 1"):
        quality.require_source(silver(spark, rows), bronze(spark, rows))


@pytest.mark.parametrize(
    "types, bad",
    [
        (["ORDER_CREATED", "PAYMENT_CONFIRMED", "REFUND_ISSUED"], False),
        (["PAYMENT_CONFIRMED", "PAYMENT_CONFIRMED"], True),
        (["PAYMENT_CONFIRMED", "REFUND_ISSUED", "REFUND_ISSUED"], True),
        (["ORDER_CREATED", "REFUND_ISSUED"], True),
    ],
)
def test_payment_patterns(spark, types, bad):
    rows = order(1, types)
    events = events_from_silver(silver(spark, rows))
    assert quality.payment_pattern_violations(events).count() == bad
    if bad:
        with pytest.raises(quality.QualityError, match="payment/refund pattern"):
            quality.require_source(silver(spark, rows), bronze(spark, rows))


def decoded(spark, *rows):
    return decode_inbox(as_inbox_rows(messages(spark, list(rows)), "retail-local", "t"))


def test_inbox_basics(spark):
    fine = decoded(spark, message(event(producer_time_utc=None), 0))
    quality.require_inbox_events(fine)
    bad = decoded(
        spark,
        message(event(), 0),
        message(event("E2", quantity=0), 1),
        message(event(" ", order_id=""), 2),
        message(event("E4", unit_price_vnd=Decimal("-1")), 3),
        message(event(), 4, value=None),
    )
    found = {r.kafka_offset: set(r.rules) for r in quality.inbox_event_violations(bad).collect()}
    assert found[1] == {"quantity"} and found[2] == {"event_id", "order_id"}
    assert found[3] == {"unit price"} and "event time" in found[4] and 0 not in found
    with pytest.raises(quality.QualityError, match="event_id: 2"):
        quality.require_inbox_events(bad)
    with pytest.raises(quality.QualityError, match="empty inbox"):
        quality.require_inbox_events(fine.limit(0))


def test_screening_never_fails(spark):
    rows = [
        message(event(), 0),
        message(event(), 1, value=b"not JSON"),
        message(event(), 2, value=b"\xff\x00"),
        message(event(), 3, value=None),
        message(event(), 4, value=b"[1, 2]"),
        message(event("E5", quantity="two", unit_price_vnd="NaN", is_late_event="perhaps"), 5),
        message(event("E6", event_time_utc="infinity", event_type="X"), 6),
    ]
    found = quality.screen_inbox(as_inbox_rows(messages(spark, rows), "c", "t")).collect()
    rules = {r.kafka_offset: set(r.rules) for r in found}
    assert rules[0] == set()
    assert all(rules[i] == {"json"} for i in (1, 2, 3, 4))
    assert rules[5] == {"quantity", "unit price", "late flag"}
    assert rules[6] == {"event or producer time", "event type"}


def test_profiles(spark, good):
    bad = damaged(good[0], {"event_date_utc": "cast(null as string)"})
    assert tuple(quality.null_profile(bad).first()) == (0, 0, 0, 1, 0)
    assert tuple(quality.duplicate_count(good[1]).first()) == (6, 1)
    assert tuple(quality.duplicate_count(good[1].limit(0)).first()) == (0, 0)
    assert values(quality.duplicate_keys(good[1], "event_id")) == {("ORD-0001-0", 2)}
    assert quality.number_violations(damaged(good[0], {"quantity": "0"})).count() == 1


def test_orphans_and_losses(spark):
    fact = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (None, 1)], "a int, b int")
    dim = spark.createDataFrame([(1,), (2,)], "k long")
    found = quality.orphan_keys(fact, {"a": (dim, "k"), "b": (dim, "k")})
    assert values(found) == {("b", 9, 1)}
    keyed = fact.withColumnRenamed("b", "k")
    assert quality.lost_in_join(keyed, dim, "k").count() == 1


def test_crosschecks(spark, good):
    events = events_from_silver(good[0])
    customers = spark.createDataFrame([(1, "C1")], "customer_key long, customer_id string")
    states = facts.order_states(events, customers)
    check = quality.payment_crosscheck(facts.payment_metrics(states), good[0]).first()
    assert check.gross_paid_vnd == check.event_paid_vnd == Decimal("200.00")
    assert check.refunded_vnd == 0 and check.event_refunded_vnd is None
    assert tuple(quality.order_count_check(good[0], states).first()) == (2, 2)


def test_audit_moves_digests_and_not_the_state_of_each_id(spark):
    rows = order(1) + order(1, city="other")
    audit = quality.event_audit(events_from_silver(silver(spark, rows)), bronze(spark, rows))
    assert values(audit, "silver_rows", "bronze_rows", "bronze_conflict") == {(1, 2, True)}
    plan = audit._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("Exchange hashpartitioning(event_id"):]
    assert plan.count("Exchange hashpartitioning(event_id") == 1 and "Aggregate" not in moved
