"""The named measures, each usable under any grouping.

A base measure is one aggregate over the order or the event frame; a ratio divides two of
them afterwards. Distinct counts are kept for keys that repeat. Where the load guarantees
one row per key, the count of rows is the same number without a shuffle of the keys:
`order_id` in orders, `event_id` in events, and `order_id` among payment events.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ordermill.functions.clock import minute_boundaries
from ordermill.functions.numbers import ratio
from ordermill.operators.quality import one_row


@dataclass(frozen=True)
class Base:
    """`how` over `value`, taken on the rows of a frame that pass `test`."""

    frame: str
    how: Callable
    value: str | Column = "*"
    test: str = None

    def column(self, tested):
        """The aggregate; `tested` says that other rows are filtered out already."""
        if self.test is None or tested:
            return self.how(self.value)
        value = F.lit(1) if isinstance(self.value, str) and self.value == "*" else self.value
        value = F.col(value) if isinstance(value, str) else value
        return self.how(F.when(F.expr(self.test), value))


@dataclass(frozen=True)
class Ratio:
    """`over` / `scale` / `under`; without data it is 0, or NULL if so declared."""

    over: str
    under: str
    scale: float = 1.0
    zero_when_empty: bool = True


_PAID = "event_type = 'PAYMENT_CONFIRMED'"


def _catalogue():
    span = lambda a, b: minute_boundaries(F.col(a), F.col(b))
    delay = span("event_time_utc", "producer_time_utc")
    to_payment = span("created_at_utc", "paid_at_utc")
    to_delivery = span("paid_at_utc", "delivered_at_utc")
    return {
        "total_orders": Base("orders", F.count),
        "paid_orders": Base("orders", F.count, test="has_payment"),
        "gross_paid": Base("orders", F.sum, "gross_paid_vnd"),
        "refunded_amount": Base("orders", F.sum, "refunded_vnd"),
        "net_paid": Base("orders", F.sum, "net_paid_vnd"),
        "average_order_value": Ratio("gross_paid", "paid_orders"),
        "delivered_orders": Base("orders", F.count, test="delivered_at_utc is not null"),
        "delivery_rate": Ratio("delivered_orders", "total_orders"),
        "cancelled_orders": Base("orders", F.count, test="is_cancelled"),
        "cancellation_rate": Ratio("cancelled_orders", "total_orders"),
        "unique_customers": Base("orders", F.count_distinct, "customer_key"),
        "total_products": Base("products", F.count),
        "sold_products": Base("events", F.count_distinct, "product_key", _PAID),
        "units_sold": Base("events", F.sum, "quantity", _PAID),
        "product_gross_paid": Base("events", F.sum, "order_total_vnd", _PAID),
        "product_paid_orders": Base("events", F.count, test=_PAID),
        "average_quantity_per_paid_order": Ratio("units_sold", "product_paid_orders"),
        "customer_orders": Base("orders", F.count),
        "customer_gross_paid": Base("orders", F.sum, "gross_paid_vnd"),
        "total_events": Base("events", F.count),
        "late_events": Base("events", F.count, test="is_late_event"),
        "late_event_rate": Ratio("late_events", "total_events"),
        "refunded_orders": Base("orders", F.count, test="has_refund"),
        "refund_rate": Ratio("refunded_orders", "paid_orders"),
        "_delay_minutes": Base("events", F.sum, delay),
        "_delayed_events": Base("events", F.count, delay),
        "average_producer_delay_minutes": Ratio("_delay_minutes", "_delayed_events", 1.0, False),
        "_to_payment_minutes": Base("orders", F.sum, to_payment),
        "_created_and_paid": Base("orders", F.count, to_payment),
        "average_creation_to_payment_hours": Ratio(
            "_to_payment_minutes", "_created_and_paid", 60.0, False
        ),
        "_to_delivery_minutes": Base("orders", F.sum, to_delivery),
        "_paid_and_delivered": Base("orders", F.count, to_delivery),
        "average_payment_to_delivery_hours": Ratio(
            "_to_delivery_minutes", "_paid_and_delivered", 60.0, False
        ),
        "paid_not_delivered_orders": Base(
            "orders", F.count, test="paid_at_utc is not null and delivered_at_utc is null"
        ),
        "distinct_event_orders": Base("events", F.count_distinct, "order_id"),
    }


def _ratio_column(rule):
    if rule.zero_when_empty:
        return ratio(F.col(rule.over), F.col(rule.under))
    return F.try_divide(F.col(rule.over) / F.lit(rule.scale), F.col(rule.under).cast("double"))


def _needed(names, catalogue):
    """Base measures behind the wanted names, in order, without repeats."""
    parts = []
    for name in names:
        rule = catalogue[name]
        parts += [name] if isinstance(rule, Base) else [rule.over, rule.under]
    return list(dict.fromkeys(parts))


def _aggregated(frame, by, wanted):
    """One frame's measures. A test shared by all of them becomes a filter of the scan."""
    tests = {rule.test for rule in wanted.values()}
    tested = len(tests) == 1 and None not in tests
    if tested:
        frame = frame.filter(tests.pop())
    columns = [rule.column(tested).alias(name) for name, rule in wanted.items()]
    return frame.groupBy(*by).agg(*columns) if by else frame.agg(*columns)


def summarise(star, measures, by=()):
    """The measures per group of `by`, or as one row when `by` is empty.

    Grouped measures must come from one frame. A single row may mix frames: each is
    aggregated on its own and the one-row results are put side by side.
    """
    catalogue = _catalogue()
    frames = {"orders": star.orders, "events": star.events, "products": star.dim_product}
    bases = {name: catalogue[name] for name in _needed(measures, catalogue)}
    grouped = []
    for name, frame in frames.items():
        wanted = {b: rule for b, rule in bases.items() if rule.frame == name}
        if wanted:
            grouped.append(_aggregated(frame, list(by), wanted))
    if by and len(grouped) > 1:
        raise ValueError("grouped measures must come from one frame")
    table = grouped[0] if len(grouped) == 1 else one_row(*grouped)
    shown = [
        (F.col(m) if m in bases else _ratio_column(catalogue[m])).alias(m) for m in measures
    ]
    return table.select(*by, *shown)


SALES_CARDS = [
    "total_orders",
    "paid_orders",
    "gross_paid",
    "refunded_amount",
    "net_paid",
    "average_order_value",
]
PRODUCT_CARDS = [
    "unique_customers",
    "sold_products",
    "units_sold",
    "product_gross_paid",
    "average_quantity_per_paid_order",
]
OPERATION_CARDS = [
    "delivery_rate",
    "cancellation_rate",
    "refund_rate",
    "late_events",
    "average_producer_delay_minutes",
    "average_payment_to_delivery_hours",
]
