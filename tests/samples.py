"""Hand-made rows for the tests."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from ordermill.operators.silver import (
    newest_per_event,
    split_datetimes,
    with_load_metadata,
)
from ordermill.schemas import BRONZE, BUSINESS_COLUMNS, DEFAULT_TOPIC, MESSAGE, SILVER

START = datetime(2026, 8, 29, 15, 16, 45, tzinfo=timezone.utc)
TYPES = ["ORDER_CREATED", "PAYMENT_CONFIRMED", "ORDER_SHIPPED", "ORDER_DELIVERED"]


def event(event_id="E1", order_id="ORD-0001", event_type="ORDER_CREATED", hours=0, delay=1, **over):
    """One valid Bronze row; `hours` after START, arriving `delay` minutes later."""
    at = START + timedelta(hours=hours)
    row = {
        "event_id": event_id,
        "order_id": order_id,
        "event_type": event_type,
        "event_time_utc": at,
        "producer_time_utc": at + timedelta(minutes=delay),
        "customer_id": "C1",
        "product_id": "P1",
        "category": "Books",
        "quantity": 2,
        "unit_price_vnd": Decimal("100.00"),
        "order_total_vnd": Decimal("200.00"),
        "payment_method": "CARD",
        "city": "Hue",
        "device": "MOBILE",
        "traffic_source": "ADS",
        "promo_code": None,
        "is_late_event": False,
    } | over
    assert set(row) == set(BUSINESS_COLUMNS)
    return row


def order(number, types=TYPES, **over):
    """The events of one order, one hour apart."""
    name = f"ORD-000{number}"
    return [
        event(f"{name}-{i}", name, kind, hours=number + i, **over) for i, kind in enumerate(types)
    ]


def bronze(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in BUSINESS_COLUMNS) for r in rows], BRONZE)


def silver(spark, rows):
    """Silver of the rows, kept as fixed values."""
    built = with_load_metadata(split_datetimes(newest_per_event(bronze(spark, rows))))
    return spark.createDataFrame(built.collect(), SILVER)


def message(row, offset, partition=0, topic=DEFAULT_TOPIC, value=False):
    """One Kafka-shaped row; a given `value` replaces the JSON."""
    if value is False:
        texts = {
            c: v.isoformat() if isinstance(v, datetime) else None if v is None else str(v).lower()
            if isinstance(v, bool) else str(v)
            for c, v in row.items()
        }
        value = json.dumps(texts, ensure_ascii=False).encode()
    return (row["order_id"].encode(), value, topic, partition, offset, START, 0)


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def values(frame, *columns):
    """Rows as a set of tuples, of all columns or of the named ones."""
    return {tuple(r) for r in (frame.select(*columns) if columns else frame).collect()}


def texts(frame):
    """Rows as sorted tuples of text, instants in UTC."""
    return sorted(
        tuple(str(v) for v in row)
        for row in frame.select(*[F.col(c).cast("string") for c in frame.columns]).collect()
    )
