"""The registered queries as plain SQL, for comparison in another engine.

Each statement starts from the given tables and states the result in its plainest form,
independent of how the Spark side computes it.
"""

from ordermill.catalog import SALES_MEASURES, SLICERS
from ordermill.schemas import (
    BUSINESS_COLUMNS,
    EVENT_TYPES,
    FACT_ORDERS_COLUMNS,
    FACT_SALES_EVENTS_COLUMNS,
    ORDER_ATTRIBUTES,
    SILVER_EVENT_COLUMNS,
)

_TYPES = ", ".join(f"'{t}'" for t in EVENT_TYPES)
_BUSINESS = ", ".join(BUSINESS_COLUMNS)
_ATTRIBUTES = ", ".join(ORDER_ATTRIBUTES)
_INSTANTS = {"event_time_utc", "producer_time_utc"}
_MONEY = {"unit_price_vnd", "order_total_vnd", "gross_paid_vnd", "refunded_vnd", "net_paid_vnd"}


def _stamp(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _show(columns, prefix=""):
    """Columns in the form the Spark side shows them."""
    out = []
    for c in columns:
        if c in _INSTANTS or c.endswith("_at_utc"):
            out.append(f"{_stamp(prefix + c)} AS {c}")
        elif c in _MONEY:
            out.append(f"CAST({prefix}{c} AS DECIMAL(28,2)) AS {c}")
        else:
            out.append(f"{prefix}{c} AS {c}")
    return ", ".join(out)


_RAW = """
o AS (
  SELECT o_orderkey AS k, o_orderkey % 100 AS r, o_custkey,
         CAST(epoch(o_orderdate) AS BIGINT) AS t0,
         o_orderkey % (SELECT count(*) FROM part) AS pk
  FROM orders
), staged AS (
  SELECT o.*, s.i, 4 * k + s.i AS n
  FROM o, (VALUES (0), (1), (2), (3)) s(i)
  WHERE NOT (r = 99 AND s.i > 0) AND NOT (r = 93 AND s.i = 3)
), timed AS (
  SELECT *, t0 + (k * 7919) % 86400 + i * (3600 + k % 1800) AS secs, n % 50 = 7 AS late
  FROM staged
), raw AS (
  SELECT t.k, t.n, c.cp,
    'EV-' || lpad(CAST(n AS VARCHAR), 15, '0') AS event_id,
    CASE WHEN k % 1000 = 450 THEN 'ORD-TEST' ELSE 'ORD-' END
      || lpad(CAST(k AS VARCHAR), 15, '0') AS order_id,
    CASE WHEN i = 0 THEN 'ORDER_CREATED' WHEN i = 1 THEN 'PAYMENT_CONFIRMED'
         WHEN i = 2 AND r < 94 THEN 'ORDER_SHIPPED' WHEN i = 2 THEN 'ORDER_CANCELLED'
         WHEN r < 94 THEN 'ORDER_DELIVERED' WHEN r < 97 THEN 'REFUND_ISSUED'
         ELSE 'CANCEL_ACKNOWLEDGED' END AS event_type,
    make_timestamp(secs * 1000000 + n % 999 * 1000 + 1) AS event_time_utc,
    make_timestamp((secs + CASE WHEN late THEN 2700 ELSE n % 60 END) * 1000000 + n % 999 * 1000 + 1)
      AS producer_time_utc,
    'CUST-' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS customer_id,
    'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 15, '0') AS product_id,
    CASE WHEN k % 7 = 0 THEN 'CLEARANCE' ELSE p_type END AS category,
    CAST(1 + k % 5 AS INTEGER) AS quantity,
    CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price_vnd,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) * (1 + k % 5) AS DECIMAL(18,2)) AS order_total_vnd,
    'PAY-' || CAST(3 * k % 4 AS VARCHAR) AS payment_method,
    'CITY-' || CAST(k % 12 AS VARCHAR) AS city,
    'DEVICE-' || CAST(k % 3 AS VARCHAR) AS device,
    'SRC-' || CAST(k % 7 AS VARCHAR) AS traffic_source,
    CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'FREESHIP' WHEN 2 THEN 'null' ELSE ' SALE10 ' END
      AS promo_code,
    late AS is_late_event
  FROM timed t JOIN part ON p_partkey = pk, (VALUES (0), (1)) c(cp)
  WHERE c.cp = 0 OR n % 499 = 0
)"""

_JSON_FIELDS = ", ".join(
    f"'{c}', strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ')"
    if c in _INSTANTS
    else f"'{c}', CAST({c} AS VARCHAR)"
    for c in BUSINESS_COLUMNS
)

_MESSAGES = f"""{_RAW}, messages AS (
  SELECT *, CAST(k % 3 AS INTEGER) AS partition_id, 2 * n + cp AS kafka_offset,
         CAST(json_object({_JSON_FIELDS}) AS VARCHAR) AS value
  FROM raw
), inbox AS (
  SELECT partition_id, kafka_offset, order_id AS message_key, value,
         date_trunc('millisecond', producer_time_utc) AS sent_at
  FROM messages
), decoded AS (
  SELECT partition_id, kafka_offset, {", ".join(
      f"CAST(value->>'$.{c}' AS TIMESTAMP) AS {c}" if c in _INSTANTS
      else f"CAST(value->>'$.{c}' AS INTEGER) AS {c}" if c == "quantity"
      else f"CAST(value->>'$.{c}' AS DECIMAL(18,2)) AS {c}" if c in _MONEY
      else f"CAST(value->>'$.{c}' AS BOOLEAN) AS {c}" if c == "is_late_event"
      else f"value->>'$.{c}' AS {c}" for c in BUSINESS_COLUMNS)}
  FROM inbox
)"""

_DAMAGED = f"""{_MESSAGES}, damaged AS (
  SELECT partition_id, kafka_offset, message_key,
    CASE WHEN (kafka_offset // 2) % 1009 = 5 THEN NULL
         WHEN (kafka_offset // 2) % 997 = 3 THEN left(value, 20)
         WHEN (kafka_offset // 2) % 991 = 2 THEN 'not '
         ELSE value END AS value
  FROM inbox
), parsed AS (
  SELECT *, coalesce(json_valid(value), false) AS good,
         CASE WHEN json_valid(value) THEN value END AS v
  FROM damaged
)"""

_SILVER = f"""{_RAW}, silver AS (
  SELECT * EXCLUDE (promo_code, rn), nullif(trim(promo_code), '') AS promo_code
  FROM (SELECT *, row_number() OVER (
          PARTITION BY event_id ORDER BY producer_time_utc DESC NULLS LAST) AS rn
        FROM raw)
  WHERE rn = 1
), ev AS (
  SELECT * REPLACE (nullif(nullif(trim(promo_code), ''), 'null') AS promo_code) FROM silver
)"""

_SPLIT = ", ".join(
    f"strftime({c}, '%H:%M:%S.%f') AS {c}"
    if c in _INSTANTS
    else f"strftime({c.replace('date', 'time')}, '%Y%d%m') AS {c}"
    if c in ("event_date_utc", "producer_date_utc")
    else _show([c])
    for c in SILVER_EVENT_COLUMNS
)

def _states(source):
    """One row per order: its newest event, and the first time of each milestone."""
    first = lambda kind: f"min(CASE event_type WHEN '{kind}' THEN event_time_utc END)"
    key = lambda column: f"CAST(strftime({column}, '%Y%m%d') AS INTEGER)"
    return f"""
  SELECT order_id, customer_key, {key("created_at_utc")} AS created_date_key,
    {key("paid_at_utc")} AS paid_date_key, {key("delivered_at_utc")} AS delivered_date_key,
    created_at_utc, paid_at_utc, shipped_at_utc, delivered_at_utc,
    newest.event_type AS latest_event_type, newest.event_time_utc AS latest_event_at_utc,
    newest.order_total_vnd, newest.payment_method, newest.city, newest.device,
    newest.traffic_source, newest.promo_code
  FROM (
    SELECT order_id, arg_max(e, row(event_time_utc, producer_time_utc, event_id)) AS newest,
      {first("ORDER_CREATED")} AS created_at_utc, {first("PAYMENT_CONFIRMED")} AS paid_at_utc,
      {first("ORDER_SHIPPED")} AS shipped_at_utc, {first("ORDER_DELIVERED")} AS delivered_at_utc
    FROM {source} e GROUP BY order_id
  ) AS orders, dim_customer WHERE dim_customer.customer_id = newest.customer_id"""


_GOLD = f"""{_SILVER}, dim_customer AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id
  FROM (SELECT DISTINCT customer_id FROM ev)
), dim_product AS (
  SELECT row_number() OVER (ORDER BY product_id, category) AS product_key, product_id, category
  FROM (SELECT DISTINCT product_id, category FROM ev)
), dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
    strftime(d, '%Y%d%m') AS date_label, CAST(day(d) AS INTEGER) AS day_of_month,
    CAST(month(d) AS INTEGER) AS month_number, CAST(quarter(d) AS INTEGER) AS quarter_number,
    CAST(year(d) AS INTEGER) AS year_number, CAST(isodow(d) AS INTEGER) AS day_of_week,
    isodow(d) IN (6, 7) AS is_weekend
  FROM (SELECT unnest(generate_series(
          (SELECT CAST(CAST(min(event_time_utc) AS DATE) AS TIMESTAMP) FROM ev),
          (SELECT CAST(CAST(greatest(max(event_time_utc), max(producer_time_utc)) AS DATE)
                       AS TIMESTAMP) FROM ev),
          INTERVAL 1 DAY)) AS d)
), fact_sales_events AS (
  SELECT ev.*, c.customer_key, p.product_key,
    CAST(strftime(event_time_utc, '%Y%m%d') AS INTEGER) AS event_date_key,
    CAST(strftime(producer_time_utc, '%Y%m%d') AS INTEGER) AS producer_date_key
  FROM ev JOIN dim_customer c USING (customer_id) JOIN dim_product p USING (product_id, category)
), fact_orders AS ({_states("ev")}
), flags AS (
  SELECT order_id,
    count(CASE event_type WHEN 'PAYMENT_CONFIRMED' THEN 1 END) > 0 AS has_payment,
    count(CASE event_type WHEN 'REFUND_ISSUED' THEN 1 END) > 0 AS has_refund,
    count(CASE WHEN event_type IN ('ORDER_CANCELLED', 'CANCEL_ACKNOWLEDGED') THEN 1 END) > 0 AS is_cancelled
  FROM ev GROUP BY order_id
), amounts AS (
  SELECT flags.*, paid_date_key, order_total_vnd, if(has_payment, order_total_vnd, 0) AS gross_paid_vnd,
    if(has_refund, order_total_vnd, 0) AS refunded_vnd
  FROM flags NATURAL JOIN (SELECT order_id, paid_date_key, order_total_vnd FROM fact_orders)
), pay AS (
  SELECT order_id, paid_date_key, order_total_vnd, has_payment, has_refund, is_cancelled,
    gross_paid_vnd, refunded_vnd, gross_paid_vnd - refunded_vnd AS net_paid_vnd
  FROM amounts
)"""

_MODEL = f"""{_GOLD}, m_events AS (
  SELECT * FROM fact_sales_events WHERE left(order_id, 7) = 'ORD-000'
), m_orders AS (
  SELECT * FROM fact_orders WHERE left(order_id, 7) = 'ORD-000'
), m_pay AS (
  SELECT * FROM pay WHERE left(order_id, 7) = 'ORD-000'
), op AS (
  SELECT o.*, p.has_payment, p.has_refund, p.is_cancelled, p.gross_paid_vnd, p.refunded_vnd,
         p.net_paid_vnd
  FROM m_orders o JOIN m_pay p USING (order_id)
)"""

_DEFECTS = f"""{_SILVER}, loaded AS (
  SELECT *, strftime(event_time_utc, '%Y%d%m') AS event_date_utc,
    strftime(producer_time_utc, '%Y%d%m') AS producer_date_utc,
    strftime(event_time_utc, '%H:%M:%S.%f') AS event_clock,
    strftime(producer_time_utc, '%H:%M:%S.%f') AS producer_clock
  FROM silver
), broken AS (
  SELECT event_id, order_id,
    CASE n % 401 WHEN 11 THEN 'ORDER_LOST' WHEN 12 THEN 'PAYMENT_CONFIRMED'
      WHEN 13 THEN 'REFUND_ISSUED' ELSE event_type END AS event_type,
    CASE WHEN n % 401 = 5 THEN ' ' || customer_id ELSE customer_id END AS customer_id,
    CASE WHEN n % 401 = 6 THEN 'Null' ELSE product_id END AS product_id,
    category,
    CASE n % 401 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN n % 401 = 3 THEN CAST(-1 AS DECIMAL(18,2)) ELSE unit_price_vnd END
      AS unit_price_vnd,
    CASE WHEN n % 401 = 4 THEN NULL ELSE order_total_vnd END AS order_total_vnd,
    payment_method, CASE WHEN n % 401 = 14 THEN 'CITY-X' ELSE city END AS city,
    device, traffic_source,
    CASE WHEN n % 401 = 15 THEN NULL ELSE promo_code END AS silver_promo,
    CASE WHEN n % 401 = 7 THEN NULL ELSE is_late_event END AS is_late_event,
    CASE n % 401 WHEN 8 THEN '20263102' WHEN 9 THEN '2026-1-2' ELSE event_date_utc END
      AS event_date_utc,
    CASE WHEN n % 401 = 10 THEN '19900101' ELSE producer_date_utc END AS producer_date_utc,
    event_clock, producer_clock
  FROM loaded
), bad AS (
  SELECT *, nullif(nullif(trim(silver_promo), ''), 'null') AS promo_code,
    try_strptime(event_date_utc || ' ' || event_clock, '%Y%d%m %H:%M:%S.%f') AS event_time_utc,
    try_strptime(producer_date_utc || ' ' || producer_clock, '%Y%d%m %H:%M:%S.%f')
      AS producer_time_utc
  FROM broken
), rawc AS (
  SELECT * REPLACE (nullif(nullif(trim(promo_code), ''), 'null') AS promo_code) FROM raw
)"""

_UNUSABLE = " OR ".join(
    f"{c} IS NULL OR trim({c}) = '' OR lower(trim({c})) = 'null' OR {c} <> trim({c})"
    for c in ["event_id", "order_id", "event_type", "customer_id", "product_id", "category"]
)

# Measures as SQL over op (orders with payments) and m_events.
_M = {
    "total_orders": "count(DISTINCT order_id)",
    "paid_orders": "count(DISTINCT order_id) FILTER (WHERE has_payment)",
    "gross_paid": "CAST(sum(gross_paid_vnd) AS DECIMAL(28,2))",
    "refunded_amount": "CAST(sum(refunded_vnd) AS DECIMAL(28,2))",
    "net_paid": "CAST(sum(net_paid_vnd) AS DECIMAL(28,2))",
    "delivered_orders": "count(DISTINCT order_id) FILTER (WHERE delivered_at_utc IS NOT NULL)",
    "cancelled_orders": "count(DISTINCT order_id) FILTER (WHERE is_cancelled)",
    "refunded_orders": "count(DISTINCT order_id) FILTER (WHERE has_refund)",
    "unique_customers": "count(DISTINCT customer_key)",
    "paid_not_delivered_orders": "count(DISTINCT order_id) FILTER "
    "(WHERE paid_at_utc IS NOT NULL AND delivered_at_utc IS NULL)",
    "total_events": "count(DISTINCT event_id)",
    "late_events": "count(DISTINCT event_id) FILTER (WHERE is_late_event)",
    "sold_products": "count(DISTINCT product_key) FILTER (WHERE event_type = 'PAYMENT_CONFIRMED')",
    "units_sold": "CAST(sum(quantity) FILTER (WHERE event_type = 'PAYMENT_CONFIRMED') AS BIGINT)",
    "product_gross_paid": "CAST(sum(order_total_vnd) FILTER "
    "(WHERE event_type = 'PAYMENT_CONFIRMED') AS DECIMAL(28,2))",
    "product_paid_orders": "count(DISTINCT order_id) FILTER "
    "(WHERE event_type = 'PAYMENT_CONFIRMED')",
}


def _ratio(over, under):
    a, b = _M.get(over, over), _M.get(under, under)
    return (
        f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), 6)"
    )


def _average(span, scale=1.0):
    return (
        f"round(CAST(sum({span}) AS DOUBLE) / {scale} / nullif(CAST(count({span}) AS DOUBLE), 0), 6)"
    )


def _minutes(start, end):
    return f"date_diff('minute', {start}, {end})"


_M |= {
    "average_order_value": _ratio("gross_paid", "paid_orders"),
    "delivery_rate": _ratio("delivered_orders", "total_orders"),
    "cancellation_rate": _ratio("cancelled_orders", "total_orders"),
    "refund_rate": _ratio("refunded_orders", "paid_orders"),
    "late_event_rate": _ratio("late_events", "total_events"),
    "average_quantity_per_paid_order": _ratio("units_sold", "product_paid_orders"),
    "average_producer_delay_minutes": _average(_minutes("event_time_utc", "producer_time_utc")),
    "average_creation_to_payment_hours": _average(
        _minutes("created_at_utc", "paid_at_utc"), 60.0
    ),
    "average_payment_to_delivery_hours": _average(
        _minutes("paid_at_utc", "delivered_at_utc"), 60.0
    ),
}


def _m(*names):
    return ", ".join(f"{_M[n]} AS {n}" for n in names)


def _with(ctes, select):
    return f"WITH {ctes.strip()}\n{select}"


def _by_day(frame, key, names):
    return _with(
        _MODEL,
        f"SELECT strftime(full_date, '%Y-%m-%d') AS full_date, {_m(*names)} "
        f"FROM {frame} JOIN dim_date ON date_key = {key} GROUP BY full_date",
    )


def _by(frame, column, names):
    return _with(_MODEL, f"SELECT {column}, {_m(*names)} FROM {frame} GROUP BY {column}")


def _listed(values):
    return ", ".join(f"'{v}'" for v in values)


def _sliced():
    days = (
        f"full_date BETWEEN DATE '{SLICERS.first_day}' AND DATE '{SLICERS.last_day}' AND "
        f"'Week ' || CAST((day_of_month - 1) // 7 + 1 AS VARCHAR) IN ({_listed(SLICERS.weeks)})"
    )
    return _with(
        f"""{_MODEL}, days AS (SELECT date_key FROM dim_date WHERE {days}), so AS (
          SELECT * FROM op WHERE paid_date_key IN (SELECT date_key FROM days)
            AND city IN ({_listed(SLICERS.cities)}) AND device IN ({_listed(SLICERS.devices)})
        ), se AS (
          SELECT * FROM m_events WHERE event_date_key IN (SELECT date_key FROM days)
            AND product_key IN (SELECT product_key FROM dim_product
                                WHERE category IN ({_listed(SLICERS.categories)}))
        )""",
        f"SELECT * FROM (SELECT {_m(*SALES_MEASURES)} FROM so), "
        f"(SELECT {_m('units_sold', 'total_events')} FROM se)",
    )


def _bad_rules():
    rules = {
        "date text": "NOT coalesce(regexp_full_match(event_date_utc, '[0-9]{8}'), false) "
        "OR NOT coalesce(regexp_full_match(producer_date_utc, '[0-9]{8}'), false)",
        "event or producer time": "event_time_utc IS NULL OR producer_time_utc IS NULL",
        "event type": f"event_type NOT IN ({_TYPES})",
        "impossible date": "event_time_utc IS NULL OR producer_time_utc IS NULL",
        "late flag": "is_late_event IS NULL",
        "order total": "order_total_vnd IS NULL OR order_total_vnd < 0",
        "producer before event": "producer_time_utc < event_time_utc",
        "quantity": "quantity IS NULL OR quantity <= 0",
        "required id": _UNUSABLE,
        "unit price": "unit_price_vnd IS NULL OR unit_price_vnd < 0",
    }
    named = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())
    return f"concat_ws(',', {named})"


_NUMBERED = "CAST(right({}, 15) AS BIGINT)"


def _delivered(time):
    """Rows with the delivery they arrive in, as the fixture deals them out."""
    first = f"(year({time}) - 1995) // 4 + CASE WHEN n % 50 = 7 OR cp = 1 THEN 1 ELSE 0 END"
    return f"""SELECT *, CAST({first} + again AS INTEGER) AS delivery
      FROM {{}}, (VALUES (0), (1)) a(again) WHERE again = 0 OR n % 997 = 1"""


def _exports():
    """Rows of the six tables as the text of their files."""
    shown = {
        "dim_date": ["date_key", "full_date", "date_label", "day_of_month", "month_number", "quarter_number",
                     "year_number", "day_of_week", "is_weekend"],
        "dim_customer": ["customer_key", "customer_id"],
        "dim_product": ["product_key", "product_id", "category"],
        "fact_sales_events": FACT_SALES_EVENTS_COLUMNS,
        "fact_orders": FACT_ORDERS_COLUMNS,
        "pay": ["order_id", "paid_date_key", "order_total_vnd", "has_payment", "has_refund", "is_cancelled",
                "gross_paid_vnd", "refunded_vnd", "net_paid_vnd"],
    }
    flags = {"is_weekend", "is_late_event", "has_payment", "has_refund", "is_cancelled"}

    def text(c):
        if c in _INSTANTS or c.endswith("_at_utc"):
            return f"{_stamp(c)} || '+00'"
        if c in flags:
            return f"CASE WHEN {c} THEN 't' WHEN NOT {c} THEN 'f' END"
        return f"CAST(CAST({c} AS DECIMAL(28,2)) AS VARCHAR)" if c in _MONEY else f"CAST({c} AS VARCHAR)"

    for table, columns in shown.items():
        fields = " || '|' || ".join(f"coalesce({text(c)}, '-')" for c in columns)
        yield "order_payment_metrics" if table == "pay" else table, table, fields


def _load_statements():
    """Results of loads, files and streams."""
    number, order = _NUMBERED.format("event_id"), _NUMBERED.format("order_id")
    actions = lambda load, event, state: " UNION ALL ".join(
        f"SELECT '{load}' AS load, '{name}' AS table_name, "
        + (
            'count(*) AS "insert", CAST(0 AS BIGINT) AS "update", CAST(0 AS BIGINT) AS same, '
            if load == "first"
            else f'CAST(0 AS BIGINT) AS "insert", count(*) FILTER ({test}) AS "update", '
            f"count(*) FILTER (NOT ({test})) AS same, "
        )
        + f"CAST(0 AS BIGINT) AS stale FROM {table}"
        for name, table, test in (
            ("fact_sales_events", "fact_sales_events", event),
            ("order_states", "fact_orders", state),
        )
    )
    null_events, null_states = f"{number} % 400 = 2", f"{order} % 300 = 2"
    loads = [
        actions("first", "false", "false"),
        actions("unchanged", "false", "false"),
        actions("repaired", f"{number} % 400 = 1", f"{order} % 300 = 1"),
        actions("pending", null_events, null_states),
        actions("null_changed", null_events, null_states),
    ]
    blank = lambda c: f"{c} IS NULL OR trim({c}) = ''"
    basic = {
        "event time": "event_time_utc IS NULL",
        "event_id": blank("event_id"),
        "event_type": blank("event_type"),
        "order total": "order_total_vnd IS NULL OR order_total_vnd < 0",
        "order_id": blank("order_id"),
        "quantity": "quantity IS NULL OR quantity <= 0",
        "unit price": "unit_price_vnd IS NULL OR unit_price_vnd < 0",
    }
    basic = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in basic.items())
    exports = list(_exports())
    windows = (
        "SELECT time_bucket(INTERVAL 5 MINUTE, event_time_utc) AS w, event_type, count(*) AS events, "
        "count(*) FILTER (WHERE is_late_event) AS late_events FROM decoded GROUP BY w, event_type"
    )
    return {
        "streamed_orders": _with(_GOLD, f"SELECT {_show(FACT_ORDERS_COLUMNS)} FROM fact_orders"),
        "restarted_orders": _with(_GOLD, f"SELECT {_show(FACT_ORDERS_COLUMNS)} FROM fact_orders"),
        "inspected_batches": _with(
            f"""{_DAMAGED}, numbered AS (
              SELECT p.*, r.n, r.cp, r.producer_time_utc AS sent FROM parsed p
              JOIN raw r ON p.kafka_offset = 2 * r.n + r.cp
            ), sent AS ({_delivered("sent").format("numbered")})""",
            "SELECT delivery AS batch, partition_id AS partition, count(*) AS rows, min(kafka_offset) AS first_offset, "
            "max(kafka_offset) AS last_offset, count(*) FILTER (WHERE NOT good) AS json_errors "
            "FROM sent GROUP BY ALL",
        ),
        "streamed_type_windows": _with(
            _MESSAGES,
            f"SELECT {_stamp('w')} AS start, {_stamp('w + INTERVAL 5 MINUTE')} AS \"end\", event_type, events, "
            f"late_events FROM ({windows}) WHERE w + INTERVAL 5 MINUTE <= "
            "(SELECT date_trunc('millisecond', max(event_time_utc)) - INTERVAL 10 MINUTE FROM decoded)",
        ),
        "streamed_dedupe": _with(_RAW, f"SELECT DISTINCT {_show(BUSINESS_COLUMNS)} FROM raw"),
        "late_rows": _with(
            f"""{_RAW}, firsts AS (SELECT * FROM raw WHERE cp = 0),
            sent AS ({_delivered("event_time_utc").format("firsts")}),
            marks AS (SELECT delivery, date_trunc('millisecond', max(max(event_time_utc)) OVER (ORDER BY delivery)) AS seen
                      FROM sent GROUP BY delivery)""",
            "SELECT d.delivery, count(event_id) AS read, count(event_id) FILTER (NOT late) AS accepted, "
            "count(event_id) FILTER (late) AS dropped FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS delivery) d LEFT JOIN ("
            "SELECT s.*, coalesce(event_time_utc <= (SELECT max(seen) FROM marks m WHERE m.delivery < s.delivery) "
            "- INTERVAL 10 MINUTE, false) AS late FROM sent s) s ON s.delivery = d.delivery GROUP BY d.delivery",
        ),
        "gold_load_actions": _with(_GOLD, " UNION ALL ".join(loads)),
        "load_report": _with(
            _GOLD,
            "SELECT (SELECT count(*) FROM silver) AS events, (SELECT count(*) FROM raw) AS bronze_rows, "
            "(SELECT count(DISTINCT order_id) FROM silver) AS orders",
        ),
        "silver_load": _with(_SILVER, f"SELECT {_SPLIT}, true AS loaded FROM silver"),
        "silver_load_from_inbox": _with(_SILVER, f"SELECT {_SPLIT}, true AS loaded FROM silver"),
        "csv_taken_once": _with(_RAW, f"SELECT {_show(BUSINESS_COLUMNS)}, CAST(k % 2 AS INTEGER) AS part FROM raw"),
        "csv_rejects": _with(
            _RAW,
            "SELECT CASE WHEN n % 401 IN (1, 2) THEN 'wrong number of fields' WHEN n % 401 = 3 THEN 'blank event_id' "
            "WHEN n % 401 IN (4, 5) THEN 'blank order_id' END AS reject_reason, count(*) AS rows FROM raw GROUP BY 1",
        ),
        "exported_gold": _with(
            _GOLD,
            " UNION ALL ".join(f"SELECT '{n}' AS table_name, {fields} AS fields FROM {t}" for n, t, fields in exports),
        ),
        "export_order": _with(
            _GOLD,
            " UNION ALL ".join(
                f"SELECT '{n}' AS table_name, count(*) AS rows, true AS in_order FROM {t}" for n, t, _ in exports
            ),
        ),
        "inbox_rule_violations": _with(
            _DEFECTS,
            f"SELECT event_id, rules FROM (SELECT event_id, concat_ws(',', {basic}) AS rules FROM bad) WHERE rules <> ''",
        ),
        "inbox_key_violations": _with(
            f"""{_MESSAGES}, keys AS (
              SELECT CASE kafka_offset % 1000 WHEN 2 THEN -1 WHEN 4 THEN NULL ELSE partition_id END AS partition_id,
                CASE kafka_offset % 1000 WHEN 6 THEN -kafka_offset ELSE kafka_offset END AS kafka_offset FROM inbox)""",
            "SELECT * FROM (SELECT partition_id, kafka_offset, CASE WHEN partition_id IS NULL THEN 'missing key part' "
            "WHEN partition_id < 0 THEN 'negative partition' WHEN kafka_offset < 0 THEN 'negative offset' "
            "WHEN kafka_offset % 1000 = 8 THEN 'repeated coordinate' END AS problem, "
            "CASE WHEN kafka_offset % 1000 = 8 THEN 2 ELSE 1 END * CAST(1 AS BIGINT) AS copies FROM keys) WHERE problem IS NOT NULL",
        ),
        "lost_in_join": _with(_SILVER, "SELECT event_id, product_id, category FROM ev WHERE category = 'CLEARANCE'"),
        "loaded_date_violations": _with(
            _SILVER,
            "SELECT event_id, CASE WHEN n % 307 = 1 THEN 'impossible date' WHEN n % 307 = 2 THEN 'date text,impossible date' ELSE 'date text' END AS rules "
            "FROM silver WHERE n % 307 IN (1, 2, 3)",
        ),
    }


def statements():
    fs = ", ".join(FACT_SALES_EVENTS_COLUMNS)
    orders_shown = _show(FACT_ORDERS_COLUMNS)
    promo_forms = (
        "nullif(trim(promo_code), '') AS silver_promo, "
        "nullif(nullif(trim(promo_code), ''), 'null') AS gold_promo"
    )
    customer_table = (
        "SELECT customer_id, count(DISTINCT order_id) AS customer_orders, "
        "CAST(sum(gross_paid_vnd) AS DECIMAL(28,2)) AS customer_gross_paid "
        "FROM op JOIN dim_customer USING (customer_key) GROUP BY customer_id"
    )
    product_table = (
        "SELECT product_id, min(p.category) AS category, "
        f"{_m('units_sold', 'product_gross_paid')} "
        "FROM m_events JOIN dim_product p USING (product_key) GROUP BY p.product_id"
    ).replace("SELECT product_id", "SELECT p.product_id")
    return _load_statements() | {
        "bronze_csv": _with(_RAW, f"SELECT {_show(BUSINESS_COLUMNS)} FROM raw"),
        "exported_metrics": _with(
            _GOLD,
            "SELECT order_id, "
            + ", ".join(
                f"CASE WHEN {c} THEN 't' ELSE 'f' END AS {c}"
                for c in ("has_payment", "has_refund", "is_cancelled")
            )
            + ", CAST(paid_date_key AS VARCHAR) AS paid_date_key, "
            + ", ".join(
                f"CAST(CAST({c} AS DECIMAL(28,2)) AS VARCHAR) AS {c}"
                for c in ("order_total_vnd", "gross_paid_vnd", "refunded_vnd", "net_paid_vnd")
            )
            + " FROM pay",
        ),
        "streamed_window_counts": (
            f"SELECT {_stamp('w')} AS start, {_stamp('w + INTERVAL 5 MINUTE')} AS \"end\", "
            "count(*) AS count FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM events) "
            "GROUP BY w HAVING w + INTERVAL 5 MINUTE <= "
            "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
        ),
        "bronze_typed": _with(_MESSAGES, f"SELECT {_show(BUSINESS_COLUMNS)} FROM decoded"),
        "order_messages": _with(
            _RAW,
            "SELECT order_id AS key, CAST(json_object("
            + ", ".join(
                f"'{c}', {_stamp(c)}" if c in _INSTANTS else f"'{c}', CAST({c} AS VARCHAR)"
                for c in BUSINESS_COLUMNS
            )
            + ") AS VARCHAR) AS value FROM raw",
        ),
        "silver_dedupe": _with(_SILVER, f"SELECT {_show(BUSINESS_COLUMNS)} FROM silver"),
        "silver_dedupe_inbox": _with(
            _MESSAGES,
            f"SELECT {_show(BUSINESS_COLUMNS)} FROM (SELECT * REPLACE "
            "(nullif(trim(promo_code), '') AS promo_code), row_number() OVER ("
            "PARTITION BY event_id ORDER BY producer_time_utc DESC NULLS LAST, partition_id, "
            "kafka_offset DESC) AS rn FROM decoded) WHERE rn = 1",
        ),
        "silver_split_datetime": _with(_SILVER, f"SELECT {_SPLIT} FROM silver"),
        "silver_rebuild_ts": _with(_SILVER, f"SELECT {_show(BUSINESS_COLUMNS)} FROM ev"),
        "promo_normalised": _with(
            _RAW,
            f"SELECT promo_code AS raw_promo, {promo_forms}, count(*) AS rows "
            "FROM raw GROUP BY promo_code",
        ),
        "parse_events": _with(
            _DAMAGED,
            "SELECT message_key AS order_key, partition_id AS partition, "
            "kafka_offset AS offset, "
            + ", ".join(f"v->>'$.{c}' AS {c}" for c in BUSINESS_COLUMNS)
            + ", NOT good AS json_parse_error FROM parsed",
        ),
        "batch_summary": _with(
            _DAMAGED,
            "SELECT partition_id AS partition, count(*) AS rows, "
            "min(kafka_offset) AS first_offset, max(kafka_offset) AS last_offset, "
            "count(*) FILTER (WHERE NOT good) AS json_errors FROM parsed GROUP BY partition_id",
        ),
        "screened_messages": _with(
            _DAMAGED,
            "SELECT partition_id, kafka_offset, v->>'$.event_id' AS event_id, "
            "CAST(v->>'$.quantity' AS INTEGER) AS quantity, "
            "CAST(v->>'$.order_total_vnd' AS DECIMAL(28,2)) AS order_total_vnd, "
            "CASE WHEN good THEN '' ELSE 'json' END AS rules FROM parsed",
        ),
        "inbox_coverage": _with(
            _MESSAGES,
            "SELECT 'derived-topic' AS source_topic_id, 'retail-order-events' AS topic, "
            "partition_id, count(*) AS rows, min(kafka_offset) AS first_offset, "
            "max(kafka_offset) AS last_offset FROM inbox GROUP BY partition_id",
        ),
        "latest_messages": _with(
            _MESSAGES,
            "SELECT partition_id, kafka_offset, message_key AS order_key, value AS raw_json "
            "FROM inbox ORDER BY sent_at DESC, partition_id DESC, kafka_offset DESC LIMIT 5",
        ),
        "inbox_conflict": _with(
            _MESSAGES,
            "SELECT 'retail-local' AS source_cluster, 'derived-topic' AS source_topic_id, "
            "partition_id, kafka_offset FROM inbox WHERE kafka_offset % 100 = 14",
        ),
        "new_inbox_rows": _with(
            _MESSAGES,
            "SELECT partition_id, kafka_offset, any_value(message_key) AS message_key FROM inbox "
            "GROUP BY partition_id, kafka_offset HAVING bool_and(kafka_offset % 2 <> 0)",
        ),
        "duplicate_events": _with(
            _RAW,
            "SELECT event_id, count(*) AS rows FROM raw GROUP BY event_id HAVING count(*) > 1",
        ),
        "null_profile": _with(
            _DEFECTS,
            "SELECT count(*) FILTER (WHERE event_id IS NULL) AS null_event_id, "
            "count(*) FILTER (WHERE order_id IS NULL) AS null_order_id, "
            "count(*) FILTER (WHERE event_type IS NULL) AS null_event_type, "
            "count(*) FILTER (WHERE event_date_utc IS NULL) AS null_event_date, "
            "count(*) FILTER (WHERE event_clock IS NULL) AS null_event_time FROM bad",
        ),
        "duplicate_count": _with(
            _RAW,
            "SELECT count(*) AS total_rows, count(*) - count(DISTINCT event_id) "
            "AS duplicate_rows FROM raw",
        ),
        "number_violations": _with(
            _DEFECTS,
            f"SELECT {_show(['event_id', 'quantity', 'unit_price_vnd', 'order_total_vnd'])} "
            "FROM bad WHERE quantity <= 0 OR unit_price_vnd < 0 OR order_total_vnd < 0",
        ),
        "silver_violations": _with(
            _DEFECTS,
            f"SELECT event_id, rules FROM (SELECT event_id, {_bad_rules()} AS rules FROM bad) "
            "WHERE rules <> ''",
        ),
        "order_attribute_conflicts": _with(
            _DEFECTS,
            f"SELECT order_id FROM (SELECT DISTINCT order_id, {_ATTRIBUTES} FROM bad) "
            "GROUP BY order_id HAVING count(*) > 1",
        ),
        "payment_pattern": _with(
            _DEFECTS,
            "SELECT * FROM (SELECT order_id, "
            "count(*) FILTER (WHERE event_type = 'PAYMENT_CONFIRMED') AS payments, "
            "count(*) FILTER (WHERE event_type = 'REFUND_ISSUED') AS refunds "
            "FROM bad GROUP BY order_id) WHERE payments > 1 OR refunds > 1 "
            "OR (refunds > 0 AND payments = 0)",
        ),
        "bronze_conflicts": _with(
            _DEFECTS,
            f"SELECT event_id FROM (SELECT DISTINCT * FROM (SELECT {_BUSINESS} FROM rawc "
            f"UNION ALL SELECT {_BUSINESS} FROM bad)) GROUP BY event_id HAVING count(*) > 1",
        ),
        "reconcile_bronze_silver": _with(
            _DEFECTS,
            f"SELECT {_show(BUSINESS_COLUMNS)}, 'left' AS side FROM (SELECT {_BUSINESS} FROM bad "
            f"EXCEPT SELECT {_BUSINESS} FROM rawc) UNION ALL "
            f"SELECT {_show(BUSINESS_COLUMNS)}, 'right' AS side FROM (SELECT {_BUSINESS} "
            f"FROM rawc EXCEPT SELECT {_BUSINESS} FROM bad)",
        ),
        "event_audit": _with(
            _DEFECTS,
            f"""SELECT silver_rows, bronze_rows, bronze_conflict, differs, count(*) AS events
            FROM (
              SELECT s.event_id, CAST(1 AS BIGINT) AS silver_rows, b.bronze_rows, b.versions > 1 AS bronze_conflict,
                e.event_id IS NOT NULL AS differs
              FROM bad s
              JOIN (SELECT event_id, count(*) AS bronze_rows, count(DISTINCT ({_BUSINESS}))
                      AS versions FROM rawc GROUP BY event_id) b USING (event_id)
              LEFT JOIN (SELECT {_BUSINESS} FROM bad EXCEPT SELECT {_BUSINESS} FROM rawc) e
                ON e.event_id = s.event_id)
            GROUP BY ALL""",
        ),
        "bag_diff": _with(
            _SILVER,
            f"SELECT {_show(BUSINESS_COLUMNS)}, 'left' AS side, count(*) AS surplus FROM ("
            f"SELECT * FROM (SELECT * REPLACE (nullif(trim(promo_code), '') AS promo_code) "
            f"FROM (SELECT {_BUSINESS} FROM raw)) "
            f"EXCEPT ALL SELECT {_BUSINESS} FROM silver) GROUP BY {_BUSINESS}",
        ),
        "insert_absent": _with(
            _SILVER,
            f"SELECT {_SPLIT} FROM silver s WHERE NOT EXISTS (SELECT 1 FROM silver t "
            "WHERE NOT t.is_late_event AND t.event_id = s.event_id)",
        ),
        "dim_date": _with(
            _GOLD,
            "SELECT * REPLACE (strftime(full_date, '%Y-%m-%d') AS full_date) FROM dim_date",
        ),
        "dim_customer": _with(_GOLD, "SELECT * FROM dim_customer"),
        "dim_product": _with(_GOLD, "SELECT * FROM dim_product"),
        "dim_extend": _with(
            f"""{_SILVER}, known AS (
              SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id
              FROM (SELECT DISTINCT customer_id FROM ev WHERE event_type = 'ORDER_CANCELLED'))""",
            "SELECT * FROM known UNION ALL SELECT (SELECT max(customer_key) FROM known) + "
            "row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id FROM ("
            "SELECT DISTINCT customer_id FROM ev "
            "WHERE customer_id NOT IN (SELECT customer_id FROM known))",
        ),
        "fact_sales_events": _with(
            _GOLD, f"SELECT {_show(FACT_SALES_EVENTS_COLUMNS)} FROM (SELECT {fs} "
            "FROM fact_sales_events)"
        ),
        "fact_orders": _with(_GOLD, f"SELECT {orders_shown} FROM fact_orders"),
        "order_payment_metrics": _with(
            _GOLD,
            "SELECT order_id, paid_date_key, "
            + _show(["order_total_vnd", "gross_paid_vnd", "refunded_vnd", "net_paid_vnd"])
            + ", has_payment, has_refund, is_cancelled FROM pay",
        ),
        "payment_totals": _with(
            _GOLD,
            "SELECT "
            + ", ".join(
                f"CAST(sum({c}) AS DECIMAL(28,2)) AS {c}"
                for c in ("gross_paid_vnd", "refunded_vnd", "net_paid_vnd")
            )
            + " FROM pay",
        ),
        "payment_crosscheck": _with(
            _GOLD,
            "SELECT * FROM (SELECT CAST(sum(gross_paid_vnd) AS DECIMAL(28,2)) AS gross_paid_vnd, "
            "CAST(sum(refunded_vnd) AS DECIMAL(28,2)) AS refunded_vnd FROM pay), ("
            "SELECT CAST(sum(order_total_vnd) FILTER (WHERE event_type = 'PAYMENT_CONFIRMED') "
            "AS DECIMAL(28,2)) AS event_paid_vnd, CAST(sum(order_total_vnd) FILTER "
            "(WHERE event_type = 'REFUND_ISSUED') AS DECIMAL(28,2)) AS event_refunded_vnd "
            "FROM silver)",
        ),
        "order_count_check": _with(
            _GOLD,
            "SELECT (SELECT count(DISTINCT order_id) FROM silver) AS silver_orders, "
            "(SELECT count(*) FROM fact_orders) AS fact_orders",
        ),
        "fk_orphans": _with(
            _GOLD,
            "SELECT 'product_key' AS key_column, product_key AS key_value, count(*) AS rows "
            "FROM fact_sales_events f WHERE NOT EXISTS (SELECT 1 FROM dim_product p "
            "WHERE p.product_key = f.product_key AND p.category <> 'CLEARANCE') "
            "GROUP BY product_key",
        ),
        "upsert_plan": _with(
            f"""{_GOLD}, undelivered AS (
              SELECT * FROM ev WHERE event_type <> 'ORDER_DELIVERED'
            ), old AS (
              SELECT s.* FROM ({_states("undelivered")}) s JOIN pay USING (order_id)
              WHERE has_payment
            ), new AS (
              SELECT * FROM ({_states("ev")}) WHERE left(order_id, 7) = 'ORD-000'
            )""",
            f"""SELECT action, {orders_shown} FROM (
              SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM old WHERE old.order_id = new.order_id)
                     THEN 'insert' WHEN same.order_id IS NOT NULL THEN 'same' ELSE 'update' END
                     AS action, new.*
              FROM new LEFT JOIN (SELECT * FROM old INTERSECT SELECT * FROM new) same
                ON same.order_id = new.order_id
              UNION ALL
              SELECT 'stale' AS action, old.* FROM old
              WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.order_id = old.order_id))""",
        ),
        "table_counts": _with(
            _GOLD,
            " UNION ALL ".join(
                f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
                for t in (
                    "dim_date",
                    "dim_customer",
                    "dim_product",
                    "fact_sales_events",
                    "fact_orders",
                )
            ),
        ),
        "calendar_labels": _with(
            _GOLD,
            "SELECT date_key, 'Week ' || CAST((day_of_month - 1) // 7 + 1 AS VARCHAR) "
            "AS week_of_month, CAST(year_number AS VARCHAR) || ' Q' || "
            "CAST(quarter_number AS VARCHAR) AS year_quarter FROM dim_date",
        ),
        "customer_measures": _with(_MODEL, customer_table),
        "sliced_cards": _sliced(),
        "order_trace": _with(
            _GOLD,
            "SELECT e.order_id, e.event_id, e.event_type, "
            f"{_show(['event_time_utc', 'producer_time_utc'], 'e.')}, e.is_late_event, "
            f"{_show(['paid_at_utc', 'delivered_at_utc'], 'o.')}, o.latest_event_type, "
            f"{_show(['latest_event_at_utc'], 'o.')} "
            "FROM fact_sales_events e JOIN fact_orders o USING (order_id) "
            "WHERE e.order_id = 'ORD-000000000000094'",
        ),
        "window_counts": (
            f"SELECT {_stamp('w')} AS start, {_stamp('w + INTERVAL 5 MINUTE')} AS \"end\", "
            "count(*) AS count FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM events) "
            "GROUP BY w"
        ),
        "event_type_windows": _with(
            _SILVER,
            f"SELECT {_stamp('w')} AS start, {_stamp('w + INTERVAL 5 MINUTE')} AS \"end\", "
            "event_type, count(*) AS events, count(*) FILTER (WHERE is_late_event) AS late_events "
            "FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, event_time_utc) AS w FROM ev) "
            "GROUP BY w, event_type",
        ),
        "affected_orders": _with(
            _GOLD,
            f"SELECT {orders_shown} FROM fact_orders WHERE order_id IN "
            "(SELECT order_id FROM ev WHERE is_late_event)",
        ),
        "kpi_sales": _with(_MODEL, f"SELECT {_m(*SALES_MEASURES)} FROM op"),
        "kpi_products": _with(
            _MODEL,
            f"SELECT * FROM (SELECT {_m('unique_customers')} FROM op), "
            "(SELECT count(DISTINCT product_key) AS total_products FROM dim_product), "
            f"(SELECT {_m('sold_products', 'units_sold', 'product_gross_paid', 'product_paid_orders', 'average_quantity_per_paid_order')} "
            "FROM m_events)",
        ),
        "kpi_operations": _with(
            _MODEL,
            f"SELECT * FROM (SELECT {_m('total_events', 'late_events', 'late_event_rate', 'average_producer_delay_minutes')} FROM m_events), "
            f"(SELECT {_m('refunded_orders', 'refund_rate', 'average_creation_to_payment_hours', 'average_payment_to_delivery_hours', 'paid_not_delivered_orders')} FROM op)",
        ),
        "revenue_by_day": _by_day(
            "op", "paid_date_key", ["gross_paid", "net_paid", "paid_orders", "refunded_amount"]
        ),
        "paid_orders_by_day": _by_day(
            "op", "paid_date_key", ["paid_orders", "gross_paid", "average_order_value"]
        ),
        "net_by_city": _by("op", "city", ["net_paid", "total_orders", "average_order_value"]),
        "payment_share": _with(
            _MODEL,
            f"SELECT payment_method, {_m('paid_orders', 'gross_paid', 'net_paid')}, "
            "round(CAST(count(DISTINCT order_id) FILTER (WHERE has_payment) AS DOUBLE) / "
            "(SELECT count(DISTINCT order_id) FROM op WHERE has_payment), 6) AS share "
            "FROM op GROUP BY payment_method",
        ),
        "gross_by_category": _with(
            _MODEL,
            f"SELECT p.category, {_m('product_gross_paid', 'units_sold')} FROM m_events "
            "JOIN dim_product p USING (product_key) GROUP BY p.category",
        ),
        "top_products": _with(
            _MODEL,
            f"SELECT * EXCLUDE (place) FROM (SELECT *, rank() OVER (ORDER BY units_sold DESC) "
            f"AS place FROM ({product_table}) WHERE units_sold IS NOT NULL) WHERE place <= 10",
        ),
        "orders_by_source": _by(
            "op", "traffic_source", ["total_orders", "gross_paid", "average_order_value"]
        ),
        "orders_by_device": _by("op", "device", ["total_orders", "gross_paid"]),
        "top_customers": _with(
            _MODEL,
            "SELECT * EXCLUDE (place) FROM (SELECT *, rank() OVER (ORDER BY customer_gross_paid "
            f"DESC) AS place FROM ({customer_table})) WHERE place <= 10",
        ),
        "events_by_type": _by(
            "m_events", "event_type", ["total_events", "late_events", "late_event_rate"]
        ),
        "orders_by_status": _by("op", "latest_event_type", ["total_orders"]),
        "late_by_day": _by_day(
            "m_events", "event_date_key", ["late_events", "total_events", "late_event_rate"]
        ),
        "delivery_hours_by_city": _by(
            "op", "city", ["average_payment_to_delivery_hours", "delivered_orders", "delivery_rate"]
        ),
        "late_detail": _with(
            _MODEL,
            f"SELECT order_id, event_type, {_show(['event_time_utc', 'producer_time_utc'])}, "
            f"{_minutes('event_time_utc', 'producer_time_utc')} AS producer_delay_minutes, "
            "is_late_event FROM m_events WHERE is_late_event",
        ),
        "funnel": _with(
            _MODEL,
            "SELECT CASE event_type "
            + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES, 1))
            + " END AS stage, event_type, count(DISTINCT order_id) AS orders "
            "FROM m_events GROUP BY event_type",
        ),
    }
