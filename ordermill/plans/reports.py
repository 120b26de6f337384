"""The report tables. Aggregates are taken per key before a dimension is joined."""

from functools import reduce

from pyspark.sql import functions as F

from ordermill.functions.clock import minute_boundaries
from ordermill.functions.numbers import ratio
from ordermill.plans.measures import summarise
from ordermill.schemas import EVENT_TYPES


def _by_day(star, key, measures):
    """Measures per calendar day; rows without a day in the calendar are left out."""
    daily = summarise(star, measures, [key])
    days = star.dim_date.select(F.col("date_key").alias(key), "full_date")
    return daily.join(days, key).select("full_date", *measures).orderBy("full_date")


def _ranked_values(frame, column, ties):
    """Greatest first; groups without a value are not shown."""
    return frame.filter(F.col(column).isNotNull()).orderBy(F.desc(column), *ties)


def revenue_by_day(star):
    return _by_day(
        star, "paid_date_key", ["gross_paid", "net_paid", "paid_orders", "refunded_amount"]
    )


def paid_orders_by_day(star):
    return _by_day(
        star, "paid_date_key", ["paid_orders", "gross_paid", "average_order_value"]
    )


def net_by_city(star):
    table = summarise(star, ["net_paid", "total_orders", "average_order_value"], ["city"])
    return _ranked_values(table, "net_paid", ["city"])


def payment_share(star):
    """Paid orders per method with their share of all paid orders."""
    table = summarise(star, ["paid_orders", "gross_paid", "net_paid"], ["payment_method"])
    everything = table.agg(F.sum("paid_orders")).scalar()
    return _ranked_values(
        table.withColumn("share", ratio(F.col("paid_orders"), everything)),
        "paid_orders",
        ["payment_method"],
    )


def gross_by_category(star):
    """Product payments per category: per product first, then over the small dimension."""
    table = summarise(star, ["product_gross_paid", "units_sold"], ["product_key"])
    return _ranked_values(
        table.join(star.dim_product, "product_key")
        .groupBy("category")
        .agg(
            F.sum("product_gross_paid").alias("product_gross_paid"),
            F.sum("units_sold").alias("units_sold"),
        ),
        "product_gross_paid",
        ["category"],
    )


def _top(frame, column, count):
    """The rows that reach the value of place `count`; ties at that place are all kept.

    The place is found over whole rows, so that it reads the same aggregate as the result
    and Spark computes that once.
    """
    ranked = frame.filter(F.col(column).isNotNull())
    rest = [c for c in frame.columns if c != column]
    top = ranked.orderBy(F.desc(column)).limit(count)
    last = top.agg(F.min(F.struct(column, *rest)).getField(column)).scalar()
    return ranked.filter(F.col(column) >= last)


def top_products(star, count=10):
    """Best-selling product ids over all their categories."""
    table = summarise(star, ["units_sold", "product_gross_paid"], ["product_key"])
    sold = (
        table.join(star.dim_product, "product_key")
        .groupBy("product_id")
        .agg(
            F.min("category").alias("category"),
            F.sum("units_sold").alias("units_sold"),
            F.sum("product_gross_paid").alias("product_gross_paid"),
        )
    )
    return _ranked_values(_top(sold, "units_sold", count), "units_sold", ["product_id"])


def orders_by_source(star):
    measures = ["total_orders", "gross_paid", "average_order_value"]
    return _ranked_values(
        summarise(star, measures, ["traffic_source"]), "total_orders", ["traffic_source"]
    )


def orders_by_device(star):
    table = summarise(star, ["total_orders", "gross_paid"], ["device"])
    return _ranked_values(table, "total_orders", ["device"])


def top_customers(star, count=10):
    """The customers who paid most; only they are looked up in the dimension."""
    table = summarise(star, ["customer_orders", "customer_gross_paid"], ["customer_key"])
    best = _top(table, "customer_gross_paid", count).join(star.dim_customer, "customer_key")
    return _ranked_values(
        best.select("customer_id", "customer_orders", "customer_gross_paid"),
        "customer_gross_paid",
        ["customer_id"],
    )


def events_by_type(star):
    return summarise(star, ["total_events", "late_events", "late_event_rate"], ["event_type"])


def orders_by_status(star):
    table = summarise(star, ["total_orders"], ["latest_event_type"])
    return _ranked_values(table, "total_orders", ["latest_event_type"])


def late_by_day(star):
    return _by_day(star, "event_date_key", ["late_events", "total_events", "late_event_rate"])


def delivery_hours_by_city(star):
    measures = ["average_payment_to_delivery_hours", "delivered_orders", "delivery_rate"]
    table = summarise(star, measures, ["city"])
    return _ranked_values(table, "average_payment_to_delivery_hours", ["city"])


def late_detail(star):
    """Every late event, the most delayed first."""
    delay = minute_boundaries(F.col("event_time_utc"), F.col("producer_time_utc"))
    late = star.events.filter("is_late_event").select(
        "order_id",
        "event_type",
        "event_time_utc",
        "producer_time_utc",
        delay.alias("producer_delay_minutes"),
        "is_late_event",
    )
    return _ranked_values(late, "producer_delay_minutes", ["order_id", "event_type"])


def funnel(star):
    """Distinct orders that reached each stage, in business order."""
    stage = reduce(
        lambda found, named: found.when(F.col("event_type") == named[1], named[0]),
        enumerate(EVENT_TYPES[1:], start=2),
        F.when(F.col("event_type") == EVENT_TYPES[0], 1),
    )
    table = summarise(star, ["distinct_event_orders"], ["event_type"])
    return table.select(
        stage.alias("stage"), "event_type", F.col("distinct_event_orders").alias("orders")
    ).orderBy("stage")


# The planned summary views are these reports under another name.
daily_sales = revenue_by_day
sales_by_category = gross_by_category
sales_by_city = net_by_city
sales_by_payment_method = payment_share
order_status_summary = orders_by_status
