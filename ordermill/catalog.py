"""Every registered query: name to (spark, sf_dir) -> DataFrame.

Instants are shown as text and fractions with six decimals, so that results can be compared
value by value with another engine.
"""

from pyspark.sql import functions as F, types as T

from ordermill.functions.text import blank_or_null_word_to_null, blank_to_null
from ordermill.operators import dims, facts, parse, quality, setdiff, silver, upsert
from ordermill.plans import loads, measures, replays, reports
from ordermill.plans.layers import Layers, saved_events, scratch, silver_rows, source_events
from ordermill.plans.star import Slicers, business_only, slice_star
from ordermill.schemas import (
    BUSINESS_COLUMNS,
    DIM_CUSTOMER,
    DIM_PRODUCT,
    FACT_ORDERS_COLUMNS,
    PAYMENT_METRICS_COLUMNS,
)
from ordermill.session import use_utc
from ordermill.sources import delimited, derived, inbox
from ordermill.streaming import windows

SALES_MEASURES = [
    "total_orders",
    "paid_orders",
    "gross_paid",
    "refunded_amount",
    "net_paid",
    "average_order_value",
    "delivered_orders",
    "delivery_rate",
    "cancelled_orders",
    "cancellation_rate",
]
PRODUCT_MEASURES = [
    "unique_customers",
    "total_products",
    "sold_products",
    "units_sold",
    "product_gross_paid",
    "product_paid_orders",
    "average_quantity_per_paid_order",
]
OPERATION_MEASURES = [
    "total_events",
    "late_events",
    "late_event_rate",
    "refunded_orders",
    "refund_rate",
    "average_producer_delay_minutes",
    "average_creation_to_payment_hours",
    "average_payment_to_delivery_hours",
    "paid_not_delivered_orders",
]
SLICERS = Slicers(
    first_day="1996-03-01",
    last_day="1999-10-31",
    weeks=["Week 1", "Week 3"],
    cities=["CITY-1", "CITY-4", "CITY-9"],
    devices=["DEVICE-0", "DEVICE-1"],
    categories=["CLEARANCE"],
)


def shown(frame):
    """Instants as text, fractions rounded, decimals at one width."""
    columns = []
    for f in frame.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(f.dataType, T.DecimalType):
            column = column.cast("decimal(28,2)")
        elif isinstance(f.dataType, T.ShortType):
            column = column.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            column = F.array_join(F.sort_array(column), ",")
        columns.append(column.alias(f.name))
    return frame.select(*columns)


def _business(spark, sf_dir):
    return business_only(Layers(spark, sf_dir).star())


def _report(build):
    return lambda spark, sf_dir: shown(build(_business(spark, sf_dir)))


def _cards(names):
    return _report(lambda star: measures.summarise(star, names))


def _query(build):
    return lambda spark, sf_dir: shown(build(spark, sf_dir))


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def _dim(spark, sf_dir, rule, schema):
    return dims.extend_dim(_empty(spark, schema), source_events(spark, sf_dir), *rule)


def bronze_typed(spark, sf_dir):
    return silver.bronze_from_inbox(derived.inbox(spark, sf_dir))


def order_messages(spark, sf_dir):
    """Rows turned into keyed JSON messages, shown as text."""
    rows = derived.raw_sales(spark, sf_dir)
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in BUSINESS_COLUMNS])
    return delimited.to_messages(texts).select(
        F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value")
    )


def silver_dedupe(spark, sf_dir):
    return silver.newest_per_event(derived.raw_sales(spark, sf_dir))


def silver_dedupe_inbox(spark, sf_dir):
    return silver.newest_inbox_copy(silver.decode_inbox(derived.inbox(spark, sf_dir)))


def silver_split_datetime(spark, sf_dir):
    return silver.split_datetimes(silver_dedupe(spark, sf_dir))


def promo_normalised(spark, sf_dir):
    """How raw promo codes read in Silver and in Gold, with their number of rows."""
    raw = F.col("promo_code")
    return (
        derived.raw_sales(spark, sf_dir)
        .groupBy(raw.alias("raw_promo"))
        .agg(F.count("*").alias("rows"))
        .select(
            "raw_promo",
            blank_to_null(F.col("raw_promo")).alias("silver_promo"),
            blank_or_null_word_to_null(F.col("raw_promo")).alias("gold_promo"),
            "rows",
        )
    )


def _parsed(spark, sf_dir):
    texts = parse.message_text(derived.messages(spark, sf_dir, damage=True))
    return parse.parse_events(texts)


def parse_events(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "order_key", "partition", "offset", *BUSINESS_COLUMNS, "json_parse_error"
    )


def batch_summary(spark, sf_dir):
    return parse.batch_summary(_parsed(spark, sf_dir))


def screened_messages(spark, sf_dir):
    return quality.screen_inbox(derived.inbox(spark, sf_dir, damage=True)).select(
        "partition_id", "kafka_offset", "event_id", "quantity", "order_total_vnd", "rules"
    )


def inbox_coverage(spark, sf_dir):
    return inbox.inbox_coverage(derived.inbox(spark, sf_dir))


def latest_messages(spark, sf_dir):
    return inbox.latest_messages(derived.inbox(spark, sf_dir))


def _redelivered(spark, sf_dir):
    """The whole topic delivered once more, late messages with changed bytes."""
    rows = derived.inbox(spark, sf_dir).drop("ingested_at")
    late = F.col("kafka_offset") % 100 == 14
    changed = F.concat(F.col("raw_value"), F.lit(" ").cast("binary"))
    return rows.withColumn("raw_value", F.when(late, changed).otherwise(F.col("raw_value")))


def inbox_conflict(spark, sf_dir):
    stored = derived.inbox(spark, sf_dir)
    return inbox.inbox_conflicts(_redelivered(spark, sf_dir), stored)


def new_inbox_rows(spark, sf_dir):
    """Messages left to store when all but the second copies are stored already."""
    every = derived.inbox(spark, sf_dir)
    stored = every.filter(F.col("kafka_offset") % 2 == 0)
    return inbox.new_inbox_rows(every.drop("ingested_at"), stored).select(
        "partition_id", "kafka_offset", F.decode("message_key", "UTF-8").alias("message_key")
    )


def duplicate_events(spark, sf_dir):
    return quality.duplicate_keys(derived.raw_sales(spark, sf_dir), "event_id")


def null_profile(spark, sf_dir):
    return quality.null_profile(derived.with_defects(silver_rows(spark, sf_dir)))


def duplicate_count(spark, sf_dir):
    return quality.duplicate_count(derived.raw_sales(spark, sf_dir))


def number_violations(spark, sf_dir):
    bad = quality.number_violations(derived.with_defects(silver_rows(spark, sf_dir)))
    return bad.select("event_id", "quantity", "unit_price_vnd", "order_total_vnd")


def silver_violations(spark, sf_dir):
    bad = quality.silver_violations(derived.with_defects(silver_rows(spark, sf_dir)))
    return bad.select("event_id", "rules")


def _defective_events(spark, sf_dir):
    return silver.events_from_silver(
        derived.with_defects(silver_rows(spark, sf_dir)), strict=False
    )


def order_attribute_conflicts(spark, sf_dir):
    return quality.order_attribute_conflicts(_defective_events(spark, sf_dir))


def payment_pattern(spark, sf_dir):
    return quality.payment_pattern_violations(_defective_events(spark, sf_dir))


def bronze_conflicts(spark, sf_dir):
    """Conflicting versions after a second delivery of all events with defects."""
    bronze = derived.raw_sales(spark, sf_dir)
    return quality.bronze_conflicts(bronze.unionByName(_defective_events(spark, sf_dir)))


def reconcile_bronze_silver(spark, sf_dir):
    bronze = silver.comparable_bronze(derived.raw_sales(spark, sf_dir))
    return setdiff.set_diff(_defective_events(spark, sf_dir), bronze)


def event_audit(spark, sf_dir):
    audit = quality.event_audit(
        _defective_events(spark, sf_dir), derived.raw_sales(spark, sf_dir)
    )
    return audit.groupBy("silver_rows", "bronze_rows", "bronze_conflict", "differs").agg(
        F.count("*").alias("events")
    )


def bag_diff(spark, sf_dir):
    """Copies that deduplication removes."""
    bronze = derived.raw_sales(spark, sf_dir)
    return setdiff.bag_diff(
        bronze.withColumn("promo_code", blank_to_null(F.col("promo_code"))),
        silver.newest_per_event(bronze),
    )


def insert_absent(spark, sf_dir):
    """Silver rows to add when all on-time events are stored already."""
    rows = silver_split_datetime(spark, sf_dir)
    return silver.insert_absent(rows.filter("not is_late_event"), rows)


def dim_date(spark, sf_dir):
    return dims.dim_date(source_events(spark, sf_dir))


def dim_customer(spark, sf_dir):
    return _dim(spark, sf_dir, dims.CUSTOMER, DIM_CUSTOMER)


def dim_product(spark, sf_dir):
    return _dim(spark, sf_dir, dims.PRODUCT, DIM_PRODUCT)


def dim_extend(spark, sf_dir):
    """Customers of cancelled orders were known first; the others follow."""
    events = source_events(spark, sf_dir)
    known = dims.extend_dim(
        _empty(spark, DIM_CUSTOMER), events.filter("event_type = 'ORDER_CANCELLED'"), *dims.CUSTOMER
    )
    return dims.extend_dim(known, events, *dims.CUSTOMER)


def fact_sales_events(spark, sf_dir):
    events = saved_events(spark, sf_dir)
    customers = dims.extend_dim(_empty(spark, DIM_CUSTOMER), events, *dims.CUSTOMER)
    products = dims.extend_dim(_empty(spark, DIM_PRODUCT), events, *dims.PRODUCT)
    return facts.event_facts(events, customers, products)


def _states(spark, sf_dir):
    return facts.order_states(source_events(spark, sf_dir), dim_customer(spark, sf_dir))


def fact_orders(spark, sf_dir):
    return facts.fact_orders(_states(spark, sf_dir))


def order_payment_metrics(spark, sf_dir):
    """The metrics view over the two stored facts."""
    layers = Layers(spark, sf_dir)
    return facts.order_payment_metrics(
        facts.fact_orders(layers.order_states()), layers.fact_sales_events()
    )


def _metrics(spark, sf_dir):
    return facts.payment_metrics(Layers(spark, sf_dir).order_states())


def payment_totals(spark, sf_dir):
    return facts.payment_totals(_metrics(spark, sf_dir))


def payment_crosscheck(spark, sf_dir):
    return quality.payment_crosscheck(_metrics(spark, sf_dir), Layers(spark, sf_dir).silver())


def order_count_check(spark, sf_dir):
    layers = Layers(spark, sf_dir)
    return quality.order_count_check(layers.silver(), layers.order_states())


def fk_orphans(spark, sf_dir):
    """Unresolved keys when clearance products are missing from their dimension."""
    layers = Layers(spark, sf_dir)
    return quality.orphan_keys(
        layers.fact_sales_events(),
        {
            "event_date_key": (layers.dim_date(), "date_key"),
            "producer_date_key": (layers.dim_date(), "date_key"),
            "customer_key": (layers.dim_customer(), "customer_key"),
            "product_key": (
                layers.dim_product().filter("category <> 'CLEARANCE'"),
                "product_key",
            ),
        },
    )


def upsert_plan(spark, sf_dir):
    """Orders as known before any delivery, against business orders of all events."""
    layers = Layers(spark, sf_dir)
    events, customers = layers.events(), layers.dim_customer()
    before = facts.order_states(events.filter("event_type <> 'ORDER_DELIVERED'"), customers)
    after = facts.order_states(events, customers)
    business = after.filter(F.col("order_id").startswith("ORD-000"))
    return upsert.upsert_plan(
        before.filter("has_payment").select(*FACT_ORDERS_COLUMNS),
        business.select(*FACT_ORDERS_COLUMNS),
        ["order_id"],
    )


def table_counts(spark, sf_dir):
    layers = Layers(spark, sf_dir)
    return upsert.table_counts(
        {
            "dim_date": layers.dim_date(),
            "dim_customer": layers.dim_customer(),
            "dim_product": layers.dim_product(),
            "fact_sales_events": layers.fact_sales_events(),
            "fact_orders": layers.order_states(),
        }
    )


def calendar_labels(spark, sf_dir):
    return Layers(spark, sf_dir).star().dim_date.select(
        "date_key", "week_of_month", "year_quarter"
    )


def customer_measures(spark, sf_dir):
    star = _business(spark, sf_dir)
    table = measures.summarise(
        star, ["customer_orders", "customer_gross_paid"], ["customer_key"]
    )
    return table.join(star.dim_customer, "customer_key").drop("customer_key")


def sliced_cards(spark, sf_dir):
    star = slice_star(_business(spark, sf_dir), SLICERS)
    return measures.summarise(star, SALES_MEASURES + ["units_sold", "total_events"])


def order_trace(spark, sf_dir):
    layers = Layers(spark, sf_dir)
    return facts.order_trace(
        layers.fact_sales_events(), layers.order_states(), "ORD-000000000000094"
    )


def window_counts(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return windows.window_counts(events, "ts")


def event_type_windows(spark, sf_dir):
    return windows.event_type_windows(source_events(spark, sf_dir))


def affected_orders(spark, sf_dir):
    """State of the orders that late events touch, rebuilt from all their events."""
    layers = Layers(spark, sf_dir)
    touched = layers.events().filter("is_late_event").select("order_id").distinct()
    events = layers.events().join(touched, "order_id", "left_semi")
    return facts.fact_orders(facts.order_states(events, layers.dim_customer()))


def bronze_csv(spark, sf_dir):
    """Raw rows written as CSV files and loaded again with their types."""
    path = f"{scratch(spark)}/raw"
    derived.raw_sales(spark, sf_dir).write.options(
        **delimited.DIALECT, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", emptyValue='""'
    ).csv(path)
    return delimited.read_bronze_csv(spark, path)


def exported_metrics(spark, sf_dir):
    """The payment metrics of the dashboard snapshot, read back as the text they hold."""
    folder = scratch(spark)
    delimited.export_snapshot(
        {"order_payment_metrics": (_metrics(spark, sf_dir), "order_id")}, folder
    )
    path = f"{folder}/order_payment_metrics"
    schema = ", ".join(f"{c} string" for c in PAYMENT_METRICS_COLUMNS)
    return spark.read.schema(schema).options(**delimited.DIALECT).csv(path)


def streamed_window_counts(spark, sf_dir):
    """Finished event-time windows of the event table read as a stream."""
    root = scratch(spark)
    events = derived.table(spark, sf_dir, "events")
    # As a pattern, the path may be one file or a folder of files.
    stream = (
        spark.readStream.schema(events.schema)
        .parquet(f"{sf_dir}/events.parque[t]")
        .select(F.col("ts").cast("timestamp").alias("ts"))
    )
    query = (
        windows.window_counts(stream, "ts")
        .writeStream.format("parquet")
        .option("path", f"{root}/windows")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, count long").parquet(
        f"{root}/windows"
    )


_PLAIN = [
    bronze_csv,
    exported_metrics,
    streamed_window_counts,
    bronze_typed,
    order_messages,
    silver_dedupe,
    silver_dedupe_inbox,
    silver_split_datetime,
    promo_normalised,
    parse_events,
    batch_summary,
    screened_messages,
    inbox_coverage,
    latest_messages,
    inbox_conflict,
    new_inbox_rows,
    duplicate_events,
    null_profile,
    duplicate_count,
    number_violations,
    silver_violations,
    order_attribute_conflicts,
    payment_pattern,
    bronze_conflicts,
    reconcile_bronze_silver,
    event_audit,
    bag_diff,
    insert_absent,
    dim_date,
    dim_customer,
    dim_product,
    dim_extend,
    fact_sales_events,
    fact_orders,
    order_payment_metrics,
    payment_totals,
    payment_crosscheck,
    order_count_check,
    fk_orphans,
    upsert_plan,
    table_counts,
    calendar_labels,
    customer_measures,
    sliced_cards,
    order_trace,
    window_counts,
    event_type_windows,
    affected_orders,
]

QUERIES = {build.__name__: _query(build) for build in [*_PLAIN, *replays.QUERIES, *loads.QUERIES]} | {
    "silver_rebuild_ts": _query(source_events),
    "kpi_sales": _cards(SALES_MEASURES),
    "kpi_products": _cards(PRODUCT_MEASURES),
    "kpi_operations": _cards(OPERATION_MEASURES),
    "revenue_by_day": _report(reports.revenue_by_day),
    "paid_orders_by_day": _report(reports.paid_orders_by_day),
    "net_by_city": _report(reports.net_by_city),
    "payment_share": _report(reports.payment_share),
    "gross_by_category": _report(reports.gross_by_category),
    "top_products": _report(reports.top_products),
    "orders_by_source": _report(reports.orders_by_source),
    "orders_by_device": _report(reports.orders_by_device),
    "top_customers": _report(reports.top_customers),
    "events_by_type": _report(reports.events_by_type),
    "orders_by_status": _report(reports.orders_by_status),
    "late_by_day": _report(reports.late_by_day),
    "delivery_hours_by_city": _report(reports.delivery_hours_by_city),
    "late_detail": _report(reports.late_detail),
    "funnel": _report(reports.funnel),
}


def flagship(spark, sf_dir):
    """Net paid by day, straight from raw rows: clean, deduplicate, roll up, report."""
    use_utc(spark)
    return QUERIES["revenue_by_day"](spark, sf_dir)
