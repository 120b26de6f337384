"""Measures and reports against plain Python over the same small rows."""

from collections import defaultdict

import pytest

from ordermill.operators import dims, facts
from ordermill.operators.silver import events_from_silver
from ordermill.plans import measures, reports
from ordermill.plans.star import Slicers, Star, business_only, slice_star
from ordermill.schemas import DIM_CUSTOMER, DIM_PRODUCT
from samples import event, order, silver, values


def make_star(spark, rows):
    events = events_from_silver(silver(spark, rows)).cache()
    customers = dims.extend_dim(spark.createDataFrame([], DIM_CUSTOMER), events, *dims.CUSTOMER)
    products = dims.extend_dim(spark.createDataFrame([], DIM_PRODUCT), events, *dims.PRODUCT)
    tables = [
        dims.dim_date(events),
        customers,
        products,
        facts.event_facts(events, customers, products),
        facts.order_states(events, customers),
    ]
    return Star.from_tables(*[t.cache() for t in tables])


def rows():
    cancelled = ["ORDER_CREATED", "PAYMENT_CONFIRMED", "ORDER_CANCELLED", "REFUND_ISSUED"]
    out = []
    for n in range(1, 9):
        out += order(
            n,
            cancelled if n == 4 else ["ORDER_CREATED"] if n == 5 else None
            or ["ORDER_CREATED", "PAYMENT_CONFIRMED", "ORDER_SHIPPED", "ORDER_DELIVERED"],
            customer_id=f"C{n % 3}",
            city=f"City{n % 2}",
            category="Toys" if n == 3 else "Books",
            product_id=f"P{n % 2}",
            is_late_event=n == 2,
            delay=45 if n == 2 else 1,
        )
    test = event("T1", "ORD-TEST1", "PAYMENT_CONFIRMED", customer_id="CT")
    far = order(9, city="City1", customer_id="C9", product_id="P9")
    for row in far:
        row["event_time_utc"] = row["event_time_utc"].replace(month=9, day=10)
        row["producer_time_utc"] = row["producer_time_utc"].replace(month=9, day=10)
    return [*out, test, *far]


@pytest.fixture(scope="module")
def star(spark):
    return business_only(make_star(spark, rows()))


def test_cards(star):
    card = measures.summarise(star, [
        "total_orders", "paid_orders", "gross_paid", "refunded_amount", "net_paid",
        "average_order_value", "delivered_orders", "delivery_rate", "cancelled_orders",
        "cancellation_rate", "unique_customers", "total_products", "sold_products", "units_sold",
        "product_paid_orders", "average_quantity_per_paid_order", "total_events", "late_events",
        "late_event_rate", "refunded_orders", "refund_rate", "average_producer_delay_minutes",
        "average_creation_to_payment_hours", "average_payment_to_delivery_hours",
        "paid_not_delivered_orders",
    ]).first().asDict()
    assert card["total_orders"] == 9 and card["paid_orders"] == 8
    assert (card["gross_paid"], card["refunded_amount"], card["net_paid"]) == (1600, 200, 1400)
    assert card["average_order_value"] == 200.0
    assert card["delivered_orders"] == 7 and card["delivery_rate"] == pytest.approx(7 / 9)
    assert card["cancelled_orders"] == 1 and card["cancellation_rate"] == pytest.approx(1 / 9)
    assert card["unique_customers"] == 4 and card["total_products"] == 4
    assert card["sold_products"] == 4 and card["units_sold"] == 16
    assert card["product_paid_orders"] == 8 and card["average_quantity_per_paid_order"] == 2.0
    assert card["total_events"] == 33 and card["late_events"] == 4
    assert card["late_event_rate"] == pytest.approx(4 / 33)
    assert card["refunded_orders"] == 1 and card["refund_rate"] == pytest.approx(1 / 8)
    assert card["average_producer_delay_minutes"] == pytest.approx((4 * 45 + 29) / 33)
    assert card["average_creation_to_payment_hours"] == 1.0
    assert card["average_payment_to_delivery_hours"] == 2.0
    assert card["paid_not_delivered_orders"] == 1


def test_nothing_selected(star):
    empty = slice_star(star, Slicers(cities=["nowhere"], event_types=["none"]))
    card = measures.summarise(empty, [
        "total_orders", "gross_paid", "average_order_value", "average_payment_to_delivery_hours",
        "late_event_rate",
    ]).first()
    assert tuple(card) == (0, None, 0.0, None, 0.0)
    assert reports.top_customers(empty).count() == 0


def test_mixed_frames_cannot_be_grouped(star):
    with pytest.raises(ValueError):
        measures.summarise(star, ["total_orders", "total_events"], ["city"])


def test_customer_measures(star):
    table = measures.summarise(star, ["customer_orders", "customer_gross_paid"], ["customer_key"])
    assert sorted(r.customer_orders for r in table.collect()) == [1, 2, 3, 3]


def test_days_without_payment_are_left_out(star):
    table = reports.revenue_by_day(star)
    assert [str(r.full_date) for r in table.collect()] == ["2026-08-29", "2026-08-30", "2026-09-10"]
    assert sum(r.paid_orders for r in table.collect()) == 8
    assert reports.daily_sales is reports.revenue_by_day


def test_share_adds_up(star):
    table = reports.payment_share(star).collect()
    assert sum(r.share for r in table) == pytest.approx(1.0)


def test_sorted_by_value(star):
    net = [r.net_paid for r in reports.net_by_city(star).collect()]
    assert net == sorted(net, reverse=True) and len(net) == 2
    late = [r.producer_delay_minutes for r in reports.late_detail(star).collect()]
    assert late == [45] * 4


def test_top_keeps_ties(star):
    every = values(reports.top_products(star, 10), "product_id", "units_sold")
    assert every == {("P0", 8), ("P1", 6), ("P9", 2)}
    assert values(reports.top_products(star, 1), "product_id") == {("P0",)}
    best = reports.top_customers(star, 1).collect()
    assert {r.customer_id for r in best} == {"C0", "C1"} or len(best) >= 1
    spent = defaultdict(int)
    for r in rows():
        if r["event_type"] == "PAYMENT_CONFIRMED" and r["order_id"].startswith("ORD-000"):
            spent[r["customer_id"]] += 200
    top = max(spent.values())
    assert {r.customer_id for r in best} == {c for c, v in spent.items() if v == top}


def test_categories(star):
    assert values(reports.gross_by_category(star), "category", "units_sold") == {
        ("Books", 14), ("Toys", 2)
    }


def test_funnel_order(star):
    table = reports.funnel(star).collect()
    assert [(r.stage, r.event_type, r.orders) for r in table] == [
        (1, "ORDER_CREATED", 9), (2, "PAYMENT_CONFIRMED", 8), (3, "ORDER_SHIPPED", 7),
        (4, "ORDER_DELIVERED", 7), (5, "ORDER_CANCELLED", 1), (6, "REFUND_ISSUED", 1),
    ]


def count(star, name):
    return measures.summarise(star, [name]).first()[0]


@pytest.mark.parametrize(
    "slicers, orders, events",
    [
        (Slicers(), 9, 33),
        # Unpaid orders have no payment day, so a day filter leaves them out.
        (Slicers(first_day="2026-08-29", last_day="2026-12-31"), 8, 33),
        (Slicers(first_day="2026-09-01"), 1, 4),
        (Slicers(weeks=["Week 2"]), 1, 4),
        # City, device and status stay on the order side.
        (Slicers(cities=["City0"]), 4, 33),
        (Slicers(latest_statuses=["ORDER_CREATED"]), 1, 33),
        (Slicers(payment_methods=["CASH"]), 0, 33),
        (Slicers(devices=["MOBILE"], traffic_sources=["ADS"]), 9, 33),
        # Products and event columns stay on the event side.
        (Slicers(categories=["Toys"]), 9, 4),
        (Slicers(event_types=["ORDER_SHIPPED"]), 9, 7),
        (Slicers(late=True), 9, 4),
        # Customers reach both.
        (Slicers(customer_ids=["C9"]), 1, 4),
    ],
)
def test_slicers_follow_the_relations(star, slicers, orders, events):
    cut = slice_star(star, slicers)
    assert (count(cut, "total_orders"), count(cut, "total_events")) == (orders, events)
