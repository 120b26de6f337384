"""Event facts, order facts and payment metrics."""

import uuid

from pyspark.sql import functions as F

from ordermill.functions.clock import date_key
from ordermill.functions.numbers import amount_when
from ordermill.schemas import (
    FACT_ORDERS_COLUMNS,
    FACT_SALES_EVENTS_COLUMNS,
    ORDER_ATTRIBUTES,
    ORDER_STATE_COLUMNS,
    PAYMENT_METRICS_COLUMNS,
)
from ordermill.session import ROWS_PER_PARTITION, shared_folder

_CANCELLED = ["ORDER_CANCELLED", "CANCEL_ACKNOWLEDGED"]


_DIMENSIONS = ["customer_id", "product_id", "category"]


def _dimension_keys(events, dim_customer, dim_product, *beside):
    """The keys of every combination of business keys (and columns `beside`) that occurs, saved."""
    found = events.select(*_DIMENSIONS, *beside).distinct()
    found = found.join(dim_customer, "customer_id").join(dim_product, ["product_id", "category"])
    path = f"{shared_folder(events.sparkSession)}/ordermill/keys/{uuid.uuid4().hex}"
    found.write.parquet(path)
    return events.sparkSession.read.schema(found.schema).parquet(path)


def _with_date_keys(events):
    return events.withColumns(
        {"event_date_key": date_key("event_time_utc"), "producer_date_key": date_key("producer_time_utc")}
    )


def event_facts(events, dim_customer, dim_product):
    """One row per event with its dimension keys.

    Keys are looked up for the combinations of business keys that occur, which are few columns and
    fewer rows; events then meet their combination, in one shuffle of whole rows at most. The
    joins carry no hint: a small side is broadcast, and otherwise a hot customer or product is many
    combinations, and a hot combination is split by the adaptive skew join.
    """
    keys = _dimension_keys(events, dim_customer, dim_product)
    return _with_date_keys(events.join(keys, _DIMENSIONS)).select(*FACT_SALES_EVENTS_COLUMNS)


def write_event_facts(events, dim_customer, dim_product, path):
    """The same as a table whose files hold few days each, in order; its schema.

    `events` are stored, as they are read several times. The one shuffle of whole rows goes by day,
    and keys go to the days in which they occur, so the rows that meet lie where they are
    written. A day with many rows is split by its combinations.
    """
    spark = events.sparkSession
    placed = _with_date_keys(events).withColumn("_day", F.coalesce("event_date_key", F.lit(0)))
    days = placed.groupBy("_day").count().agg(F.sum("count"), F.max("count")).first()
    tasks, slices = ((n or 0) // ROWS_PER_PARTITION + 1 for n in days)
    placed = placed.withColumn("_slice", F.pmod(F.xxhash64(*_DIMENSIONS), F.lit(slices)))
    place = ["_day", "_slice"]
    keys = _dimension_keys(placed, dim_customer, dim_product, *place)
    rows = placed.repartition(tasks, *place).join(keys.repartition(tasks, *place), [*place, *_DIMENSIONS])
    rows = rows.sortWithinPartitions("event_date_key").select(*FACT_SALES_EVENTS_COLUMNS)
    # Both sides are dealt out by day and slice, which is enough for a join on these and more.
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows.write.mode("overwrite").parquet(path, compression="zstd")
    finally:
        spark.conf.set(name, before)
    return rows.schema


def _payment_flags():
    kind = F.col("event_type")
    return [
        F.bool_or(kind == "PAYMENT_CONFIRMED").alias("has_payment"),
        F.bool_or(kind == "REFUND_ISSUED").alias("has_refund"),
        F.bool_or(kind.isin(_CANCELLED)).alias("is_cancelled"),
    ]


_MILESTONES = {
    "created_at_utc": "ORDER_CREATED",
    "paid_at_utc": "PAYMENT_CONFIRMED",
    "shipped_at_utc": "ORDER_SHIPPED",
    "delivered_at_utc": "ORDER_DELIVERED",
}
_ATTRIBUTES = ORDER_ATTRIBUTES[1:]
_LATEST = ["latest_event_at_utc", "latest_producer_at_utc", "latest_event_id", "latest_event_type"]


def event_states(events, customer="customer_id"):
    """Each event as the state of an order that consists of it alone."""
    kind, at = F.col("event_type"), F.col("event_time_utc")
    return events.select(
        "order_id",
        *[F.when(kind == wanted, at).alias(name) for name, wanted in _MILESTONES.items()],
        at.alias("latest_event_at_utc"),
        F.col("producer_time_utc").alias("latest_producer_at_utc"),
        F.col("event_id").alias("latest_event_id"),
        kind.alias("latest_event_type"),
        customer,
        *_ATTRIBUTES,
        (kind == "PAYMENT_CONFIRMED").cast("long").alias("payments"),
        (kind == "REFUND_ISSUED").cast("long").alias("refunds"),
        F.lit(1).cast("long").alias("event_count"),
        kind.isin(_CANCELLED).alias("is_cancelled"),
    )


def combine_states(states, customer="customer_id"):
    """One state per order from any number of partial ones, in one aggregation.

    Milestones are earliest times, the latest event is the greatest (event time, producer
    time, event id) and gives the attributes. Least and greatest attribute tuple differ
    exactly when an order has two, which `attributes_conflict` tells. All of it combines
    before the shuffle, so a huge order costs no more than a small one.
    """
    attributes = F.struct(customer, *_ATTRIBUTES)
    return (
        states.groupBy("order_id")
        .agg(
            *[F.min(name).alias(name) for name in _MILESTONES],
            F.max(F.struct(*_LATEST, customer, *_ATTRIBUTES)).alias("latest"),
            (~F.min(attributes).eqNullSafe(F.max(attributes))).alias("attributes_conflict"),
            F.sum("payments").alias("payments"),
            F.sum("refunds").alias("refunds"),
            F.sum("event_count").alias("event_count"),
            F.bool_or("is_cancelled").alias("is_cancelled"),
        )
        .select("*", "latest.*")
        .withColumns(
            {
                "created_date_key": date_key("created_at_utc"),
                "paid_date_key": date_key("paid_at_utc"),
                "delivered_date_key": date_key("delivered_at_utc"),
                "has_payment": F.col("payments") > 0,
                "has_refund": F.col("refunds") > 0,
            }
        )
        .drop("latest")
    )


def order_rollup(events):
    """Per order: milestones, latest event with its attributes, and payment counts."""
    return combine_states(event_states(events))


def checked_order_states(events, dim_customer):
    """`order_states` with `attributes_conflict` beside it."""
    return (
        order_rollup(events)
        .join(dim_customer, "customer_id")
        .select(*ORDER_STATE_COLUMNS, "attributes_conflict")
    )


def order_states(events, dim_customer):
    """fact_orders with its payment flags and what is needed to add later events.

    Keeping both in one row makes the 1:1 relation of orders and payment metrics free.
    """
    return checked_order_states(events, dim_customer).select(*ORDER_STATE_COLUMNS)


def stored_states(states, conflict=None):
    """One state per order from stored partial ones, in the stored columns.

    With `conflict`, the name of a column of partial states, an order is in conflict as well when
    any of its parts was.
    """
    combined = combine_states(states, "customer_key")
    if not conflict:
        return combined.select(*ORDER_STATE_COLUMNS)
    found = states.groupBy("order_id").agg(F.bool_or(conflict).alias("_before"))
    return combined.join(found, "order_id").select(
        *ORDER_STATE_COLUMNS, (F.col("attributes_conflict") | F.col("_before")).alias("attributes_conflict")
    )


def fact_orders(states):
    return states.select(*FACT_ORDERS_COLUMNS)


def with_amounts(states):
    """Gross, refunded and net amount per order, under the full-refund model."""
    total = F.col("order_total_vnd")
    return states.withColumns(
        {
            "gross_paid_vnd": amount_when(F.col("has_payment"), total),
            "refunded_vnd": amount_when(F.col("has_refund"), total),
        }
    ).withColumn(
        "net_paid_vnd", (F.col("gross_paid_vnd") - F.col("refunded_vnd")).cast("decimal(19,2)")
    )


def payment_metrics(states):
    """Payment metrics from rows that carry the flags already."""
    return with_amounts(states).select(*PAYMENT_METRICS_COLUMNS)


def order_payment_metrics(orders, event_fact):
    """Payment metrics from the two facts: flags per order joined to the orders."""
    flags = event_fact.groupBy("order_id").agg(*_payment_flags())
    return payment_metrics(orders.join(flags, "order_id"))


def payment_totals(metrics):
    return metrics.agg(
        *[F.sum(c).alias(c) for c in ("gross_paid_vnd", "refunded_vnd", "net_paid_vnd")]
    )


def order_trace(event_fact, orders, order_id):
    """The events of one order in time order, each with the order's resulting state."""
    chosen = F.col("order_id") == order_id
    state = orders.filter(chosen).select(
        "order_id", "paid_at_utc", "delivered_at_utc", "latest_event_type", "latest_event_at_utc"
    )
    steps = event_fact.filter(chosen).select(
        "order_id", "event_id", "event_type", "event_time_utc", "producer_time_utc", "is_late_event"
    )
    return steps.join(state, "order_id").orderBy("event_time_utc", "event_id")
