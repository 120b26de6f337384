"""Declared schemas, column lists and closed value lists of every layer."""

from pyspark.sql import types as T

# The seventeen business columns, in file order.
BUSINESS_COLUMNS = [
    "event_id",
    "order_id",
    "event_type",
    "event_time_utc",
    "producer_time_utc",
    "customer_id",
    "product_id",
    "category",
    "quantity",
    "unit_price_vnd",
    "order_total_vnd",
    "payment_method",
    "city",
    "device",
    "traffic_source",
    "promo_code",
    "is_late_event",
]

# The closed list of event types, in business order.
EVENT_TYPES = [
    "ORDER_CREATED",
    "PAYMENT_CONFIRMED",
    "ORDER_SHIPPED",
    "ORDER_DELIVERED",
    "ORDER_CANCELLED",
    "REFUND_ISSUED",
    "CANCEL_ACKNOWLEDGED",
]

# Default source names, event text dates are year, day, month.
DEFAULT_CLUSTER = "retail-local"
DEFAULT_TOPIC = "retail-order-events"
BUSINESS_PREFIX = "ORD-000"
TEXT_DATE = "yyyyddMM"
TEXT_TIME = "HH:mm:ss.SSSSSS"

MONEY = T.DecimalType(18, 2)

BUSINESS_TYPES = {
    "event_time_utc": T.TimestampType(),
    "producer_time_utc": T.TimestampType(),
    "quantity": T.IntegerType(),
    "unit_price_vnd": MONEY,
    "order_total_vnd": MONEY,
    "is_late_event": T.BooleanType(),
}

BRONZE = T.StructType(
    [T.StructField(c, BUSINESS_TYPES.get(c, T.StringType())) for c in BUSINESS_COLUMNS]
)

MESSAGE_JSON = T.StructType([T.StructField(c, T.StringType()) for c in BUSINESS_COLUMNS])

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)

INBOX_KEY = ["source_cluster", "source_topic_id", "partition_id", "kafka_offset"]
INBOX_CONTENT = ["topic", "message_key", "raw_value", "kafka_timestamp_ms"]

INBOX = T.StructType(
    [
        T.StructField("source_cluster", T.StringType()),
        T.StructField("source_topic_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("message_key", T.BinaryType()),
        T.StructField("raw_value", T.BinaryType()),
        T.StructField("kafka_timestamp_ms", T.LongType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

_SILVER_TYPES = BUSINESS_TYPES | {
    "event_time_utc": T.StringType(),
    "producer_time_utc": T.StringType(),
}

SILVER_EVENT_COLUMNS = BUSINESS_COLUMNS + ["event_date_utc", "producer_date_utc"]

SILVER = T.StructType(
    [
        T.StructField(c, _SILVER_TYPES.get(c, T.StringType()))
        for c in SILVER_EVENT_COLUMNS + ["loaded_date_utc", "loaded_time_utc"]
    ]
)

DIM_DATE = T.StructType(
    [
        T.StructField("date_key", T.IntegerType()),
        T.StructField("full_date", T.DateType()),
        T.StructField("date_label", T.StringType()),
        T.StructField("day_of_month", T.ShortType()),
        T.StructField("month_number", T.ShortType()),
        T.StructField("quarter_number", T.ShortType()),
        T.StructField("year_number", T.ShortType()),
        T.StructField("day_of_week", T.ShortType()),
        T.StructField("is_weekend", T.BooleanType()),
    ]
)

DIM_CUSTOMER = T.StructType(
    [
        T.StructField("customer_key", T.LongType()),
        T.StructField("customer_id", T.StringType()),
    ]
)

DIM_PRODUCT = T.StructType(
    [
        T.StructField("product_key", T.LongType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

FACT_SALES_EVENTS_COLUMNS = [
    "event_id",
    "order_id",
    "event_type",
    "event_date_key",
    "producer_date_key",
    "customer_key",
    "product_key",
    "event_time_utc",
    "producer_time_utc",
    "quantity",
    "unit_price_vnd",
    "order_total_vnd",
    "payment_method",
    "city",
    "device",
    "traffic_source",
    "promo_code",
    "is_late_event",
]

FACT_ORDERS_COLUMNS = [
    "order_id",
    "customer_key",
    "created_date_key",
    "paid_date_key",
    "delivered_date_key",
    "created_at_utc",
    "paid_at_utc",
    "shipped_at_utc",
    "delivered_at_utc",
    "latest_event_type",
    "latest_event_at_utc",
    "order_total_vnd",
    "payment_method",
    "city",
    "device",
    "traffic_source",
    "promo_code",
]

PAYMENT_FLAGS = ["has_payment", "has_refund", "is_cancelled"]

# What a stored order needs beyond its fact columns, so that later events can be added
# to it without reading the earlier ones.
ORDER_STATE_COLUMNS = FACT_ORDERS_COLUMNS + [
    "has_payment",
    "has_refund",
    "is_cancelled",
    "latest_producer_at_utc",
    "latest_event_id",
    "product_id",
    "category",
    "quantity",
    "unit_price_vnd",
    "payments",
    "refunds",
    "event_count",
]

PAYMENT_METRICS_COLUMNS = [
    "order_id",
    "paid_date_key",
    "order_total_vnd",
    "has_payment",
    "has_refund",
    "is_cancelled",
    "gross_paid_vnd",
    "refunded_vnd",
    "net_paid_vnd",
]

# Attributes that must be identical on every event of one order.
ORDER_ATTRIBUTES = [
    "customer_id",
    "product_id",
    "category",
    "quantity",
    "unit_price_vnd",
    "order_total_vnd",
    "payment_method",
    "city",
    "device",
    "traffic_source",
    "promo_code",
]


# Types of the columns that facts have and Bronze has not.
_FACT_TYPES = {
    "customer_key": T.LongType(),
    "product_key": T.LongType(),
    "event_date_key": T.IntegerType(),
    "producer_date_key": T.IntegerType(),
    "created_date_key": T.IntegerType(),
    "paid_date_key": T.IntegerType(),
    "delivered_date_key": T.IntegerType(),
    "created_at_utc": T.TimestampType(),
    "paid_at_utc": T.TimestampType(),
    "shipped_at_utc": T.TimestampType(),
    "delivered_at_utc": T.TimestampType(),
    "latest_event_at_utc": T.TimestampType(),
    "latest_producer_at_utc": T.TimestampType(),
    "latest_event_type": T.StringType(),
    "latest_event_id": T.StringType(),
    "has_payment": T.BooleanType(),
    "has_refund": T.BooleanType(),
    "is_cancelled": T.BooleanType(),
    "payments": T.LongType(),
    "refunds": T.LongType(),
    "event_count": T.LongType(),
}


def _fact_schema(columns):
    types = {f.name: f.dataType for f in BRONZE} | _FACT_TYPES
    return T.StructType([T.StructField(c, types[c]) for c in columns])


FACT_SALES_EVENTS = _fact_schema(FACT_SALES_EVENTS_COLUMNS)
ORDER_STATES = _fact_schema(ORDER_STATE_COLUMNS)
