"""The star schema as reports see it, with slicers that follow its relations."""

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ordermill.functions.clock import week_of_month, year_quarter
from ordermill.operators.facts import with_amounts
from ordermill.schemas import BUSINESS_PREFIX


@dataclass(frozen=True)
class Star:
    """Dimensions, the event fact, and the order fact with its payment metrics beside it.

    Orders and payment metrics are one frame, because their relation is 1:1 and filters
    go both ways.
    """

    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    events: DataFrame
    orders: DataFrame

    @classmethod
    def from_tables(cls, dim_date, dim_customer, dim_product, fact_sales_events, order_states):
        return cls(
            dim_date.withColumns(
                {
                    "week_of_month": week_of_month(F.col("day_of_month")),
                    "year_quarter": year_quarter(F.col("year_number"), F.col("quarter_number")),
                }
            ),
            dim_customer,
            dim_product,
            fact_sales_events,
            with_amounts(order_states),
        )


def business_only(star):
    """Drop test orders. The prefix test reaches the Parquet scan."""
    real = F.col("order_id").startswith(BUSINESS_PREFIX)
    return replace(star, events=star.events.filter(real), orders=star.orders.filter(real))


@dataclass(frozen=True)
class Slicers:
    """Report filters. Each is a list of accepted values; an empty one does not filter."""

    first_day: str = None
    last_day: str = None
    weeks: list = field(default_factory=list)
    cities: list = field(default_factory=list)
    payment_methods: list = field(default_factory=list)
    devices: list = field(default_factory=list)
    traffic_sources: list = field(default_factory=list)
    latest_statuses: list = field(default_factory=list)
    categories: list = field(default_factory=list)
    customer_ids: list = field(default_factory=list)
    event_types: list = field(default_factory=list)
    late: bool = None


def _accept(frame, **values):
    for column, accepted in values.items():
        if accepted:
            frame = frame.filter(F.col(column).isin(accepted))
    return frame


def slice_star(star, slicers):
    """Apply the slicers along the relations of the model.

    Days reach orders by payment date, so unpaid orders drop out, and events by event
    date. Customers reach orders and events, products reach events only. Filters on an
    order column stay with orders and payments; filters on an event column with events.
    """
    s = slicers
    dates = _accept(star.dim_date, week_of_month=s.weeks)
    if s.first_day:
        dates = dates.filter(F.col("full_date") >= F.lit(s.first_day).cast("date"))
    if s.last_day:
        dates = dates.filter(F.col("full_date") <= F.lit(s.last_day).cast("date"))
    customers = _accept(star.dim_customer, customer_id=s.customer_ids)
    products = _accept(star.dim_product, category=s.categories)
    orders = _accept(
        star.orders,
        city=s.cities,
        payment_method=s.payment_methods,
        device=s.devices,
        traffic_source=s.traffic_sources,
        latest_event_type=s.latest_statuses,
    )
    events = _accept(star.events, event_type=s.event_types)
    if s.late is not None:
        events = events.filter(F.col("is_late_event") == s.late)
    if s.first_day or s.last_day or s.weeks:
        by = lambda column: dates.select(F.col("date_key").alias(column))
        orders = orders.join(by("paid_date_key"), "paid_date_key", "left_semi")
        events = events.join(by("event_date_key"), "event_date_key", "left_semi")
    if s.customer_ids:
        keys = customers.select("customer_key")
        orders = orders.join(keys, "customer_key", "left_semi")
        events = events.join(keys, "customer_key", "left_semi")
    if s.categories:
        events = events.join(products.select("product_key"), "product_key", "left_semi")
    return Star(dates, customers, products, events, orders)
