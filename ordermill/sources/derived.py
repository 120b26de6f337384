"""Raw retail events derived from the `orders` and `part` tables.

One order yields up to four lifecycle events, some with an exact second copy, so the
row count grows with `orders`. The rules are listed in FIXTURES.md.
"""

from pyspark.sql import functions as F, types as T

from ordermill.schemas import BRONZE, BUSINESS_COLUMNS, DEFAULT_CLUSTER, DEFAULT_TOPIC, MONEY
from ordermill.session import enough_partitions, use_utc

TOPIC_ID = "derived-topic"
ORDERS_PER_TASK = 25_000
EVENTS_PER_ORDER = 4


def table(spark, sf_dir, name):
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered_events(spark, sf_dir):
    """Business columns plus `k` (order number), `n` (event number) and `cp` (copy)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    parts = part.count()
    # What is made of each order is much more than its row, so tasks are counted by orders: by the
    # bytes of their rows adaptive execution would put millions of events into one task. There are
    # two at least: a single partition serves every later grouping, so all of them would stay in one task.
    count = orders.count()
    tasks = max(2, count // ORDERS_PER_TASK + 1)
    enough_partitions(spark, count * EVENTS_PER_ORDER)

    k, r, i, n = F.col("k"), F.col("r"), F.col("i"), F.col("n")
    last_stage = F.when(r == 99, 0).when(r == 93, 2).otherwise(3)
    pad = lambda number: F.lpad(number.cast("string"), 15, "0")
    price = F.col("p_retailprice").cast(MONEY)
    quantity = (k % 5 + 1).cast("int")
    # What all events of an order share is made once for the order.
    shared = {
        "order_id": F.concat(F.when(k % 1000 == 450, "ORD-TEST").otherwise("ORD-"), pad(k)),
        "customer_id": F.concat(F.lit("CUST-"), pad(F.col("o_custkey"))),
        "product_id": F.concat(F.lit("SKU-"), pad(F.col("p_partkey"))),
        "category": F.when(k % 7 == 0, "CLEARANCE").otherwise(F.col("p_type")),
        "quantity": quantity,
        "unit_price_vnd": price,
        "order_total_vnd": (price * quantity).cast(MONEY),
        "payment_method": F.concat(F.lit("PAY-"), (k * 3 % 4).cast("string")),
        "city": F.concat(F.lit("CITY-"), (k % 12).cast("string")),
        "device": F.concat(F.lit("DEVICE-"), (k % 3).cast("string")),
        "traffic_source": F.concat(F.lit("SRC-"), (k % 7).cast("string")),
        "promo_code": F.when(k % 4 == 0, "")
        .when(k % 4 == 1, "FREESHIP")
        .when(k % 4 == 2, "null")
        .otherwise(" SALE10 "),
        "_start": F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k * 7919 % 86400,
    }
    staged = (
        orders.withColumn("k", F.col("o_orderkey"))
        .withColumn("r", (k % 100).cast("int"))
        .withColumn("p_partkey", k % parts)
        .repartition(tasks, "p_partkey")
        .join(part.repartition(tasks, "p_partkey"), "p_partkey")
        .select("k", "r", *[v.alias(c) for c, v in shared.items()])
        .withColumn("i", F.explode(F.sequence(F.lit(0), last_stage)))
        .withColumn("n", k * 4 + i)
        .withColumn(
            "cp",
            F.explode(
                F.when(n % 499 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            ),
        )
    )
    late = n % 50 == 7
    micros = n % 999 * 1000 + 1
    event_seconds = F.col("_start") + i * (k % 1800 + 3600)
    instant = lambda seconds: F.timestamp_micros(seconds * 1_000_000 + micros)
    of_event = {
        "event_id": F.concat(F.lit("EV-"), pad(n)),
        "event_type": F.when(i == 0, "ORDER_CREATED")
        .when(i == 1, "PAYMENT_CONFIRMED")
        .when((i == 2) & (r < 94), "ORDER_SHIPPED")
        .when(i == 2, "ORDER_CANCELLED")
        .when(r < 94, "ORDER_DELIVERED")
        .when(r < 97, "REFUND_ISSUED")
        .otherwise("CANCEL_ACKNOWLEDGED"),
        "event_time_utc": instant(event_seconds),
        "producer_time_utc": instant(
            event_seconds + F.when(late, F.lit(2700).cast("long")).otherwise(n % 60)
        ),
        "is_late_event": late,
    }
    return staged.select(
        *[of_event[c].alias(c) if c in of_event else F.col(c) for c in BUSINESS_COLUMNS], "k", "n", "cp"
    )


def with_defects(rows):
    """Silver-shaped rows with every kind of defect the rules name, spread by event number."""
    n = F.substring("event_id", 4, 15).cast("long")
    slot = n % 401
    broken = {
        "quantity": F.when(slot == 1, 0).when(slot == 2, None).otherwise(F.col("quantity")),
        "unit_price_vnd": F.when(slot == 3, F.lit(-1).cast(MONEY)).otherwise(
            F.col("unit_price_vnd")
        ),
        "order_total_vnd": F.when(slot == 4, F.lit(None).cast(MONEY)).otherwise(
            F.col("order_total_vnd")
        ),
        "customer_id": F.when(slot == 5, F.concat(F.lit(" "), "customer_id")).otherwise(
            F.col("customer_id")
        ),
        "product_id": F.when(slot == 6, "Null").otherwise(F.col("product_id")),
        "is_late_event": F.when(slot == 7, None).otherwise(F.col("is_late_event")),
        "event_date_utc": F.when(slot == 8, "20263102")
        .when(slot == 9, "2026-1-2")
        .otherwise(F.col("event_date_utc")),
        "producer_date_utc": F.when(slot == 10, "19900101").otherwise(F.col("producer_date_utc")),
        "event_type": F.when(slot == 11, "ORDER_LOST")
        .when(slot == 12, "PAYMENT_CONFIRMED")
        .when(slot == 13, "REFUND_ISSUED")
        .otherwise(F.col("event_type")),
        "city": F.when(slot == 14, "CITY-X").otherwise(F.col("city")),
        "promo_code": F.when(slot == 15, None).otherwise(F.col("promo_code")),
    }
    return rows.withColumns(broken)


def raw_sales(spark, sf_dir, *numbers):
    """Typed Bronze rows, duplicates kept; `numbers` names columns of the fixture to keep beside them."""
    rows = _numbered_events(spark, sf_dir).select(*BUSINESS_COLUMNS, *numbers)
    return rows.to(T.StructType([*BRONZE.fields, *[rows.schema[c] for c in numbers]]))


def messages(spark, sf_dir, damage=False):
    """The same events as source messages: JSON of strings keyed by order.

    With `damage`, some values are cut short, are no UTF-8, or are missing.
    """
    rows = _numbered_events(spark, sf_dir)
    n = F.col("n")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    as_text = [
        (stamp(c) if c in ("event_time_utc", "producer_time_utc") else F.col(c).cast("string"))
        .alias(c)
        for c in BUSINESS_COLUMNS
    ]
    value = F.to_json(F.struct(*as_text), {"ignoreNullFields": "false"}).cast("binary")
    if damage:
        value = (
            F.when(n % 1009 == 5, F.lit(None).cast("binary"))
            .when(n % 997 == 3, F.substring(value, 1, 20))
            .when(n % 991 == 2, F.unhex(F.lit("6E6F7420FF")))
            .otherwise(value)
        )
    return rows.select(
        F.col("order_id").cast("binary").alias("key"),
        value.alias("value"),
        F.lit(DEFAULT_TOPIC).alias("topic"),
        (F.col("k") % 3).cast("int").alias("partition"),
        (n * 2 + F.col("cp")).alias("offset"),
        F.col("producer_time_utc").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


FIRST_YEAR, YEARS, DELIVERIES = 1995, 4, 4


def deliveries(rows, at="timestamp", number="offset div 2", copy="offset % 2"):
    """Rows with the `delivery` in which they arrive, 0 to DELIVERIES - 1.

    Rows come by years; late events and second copies come one delivery later, and every 997th
    message comes once more in the next one.
    """
    n = F.expr(number)
    first = F.floor((F.year(at) - FIRST_YEAR) / YEARS).cast("int")
    first = first + F.when((n % 50 == 7) | (F.expr(copy) == 1), 1).otherwise(0)
    again = F.when(n % 997 == 1, F.array(first, first + 1)).otherwise(F.array(first))
    return rows.withColumn("delivery", F.explode(again))


def inbox(spark, sf_dir, damage=False):
    """The messages as stored inbox rows."""
    from ordermill.sources.inbox import as_inbox_rows

    rows = as_inbox_rows(messages(spark, sf_dir, damage), DEFAULT_CLUSTER, TOPIC_ID)
    return rows.withColumn("ingested_at", F.timestamp_millis("kafka_timestamp_ms"))
