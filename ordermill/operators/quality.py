"""Data-quality rules.

Every rule has a row form, which returns the offending rows as a DataFrame, and a
requiring form, which raises `QualityError` with the names of the broken rules.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ordermill.functions.clock import is_text_date, rebuild_timestamp
from ordermill.functions.digest import DIGEST, several, unlike, with_digest
from ordermill.functions.text import any_unusable_id, blank_to_null, utf8_text
from ordermill.operators.facts import order_rollup
from ordermill.operators.parse import tolerant_json, unread
from ordermill.operators.silver import comparable_bronze, events_from_silver, typed_columns
from ordermill.schemas import BUSINESS_COLUMNS, EVENT_TYPES


class QualityError(ValueError):
    """The load was stopped; `counts` holds the number of offenders per rule."""

    def __init__(self, counts):
        self.counts = counts
        super().__init__("; ".join(f"{rule}: {n}" for rule, n in counts.items()))


_REQUIRED_IDS = ["event_id", "order_id", "event_type", "customer_id", "product_id", "category"]


def _missing_or(column, test):
    return F.col(column).isNull() | test


def _amount_problem(column):
    return _missing_or(column, F.col(column) < 0)


def _event_rules(event="event_time_utc", producer="producer_time_utc"):
    """Rules over rebuilt events; a value that could not be converted is NULL here."""
    return {
        "required id": any_unusable_id(_REQUIRED_IDS),
        "event or producer time": F.col(event).isNull() | F.col(producer).isNull(),
        "quantity": _missing_or("quantity", F.col("quantity") <= 0),
        "unit price": _amount_problem("unit_price_vnd"),
        "order total": _amount_problem("order_total_vnd"),
        "late flag": F.col("is_late_event").isNull(),
        "producer before event": F.col(producer) < F.col(event),
        "event type": ~F.col("event_type").isin(EVENT_TYPES),
    }


_STAMPS = ["event", "producer", "loaded"]


def _with_stamps(silver):
    """Silver with each date and time text pair rebuilt beside it, NULL where impossible.

    The generator keeps the rebuilding below the rules: they read its result, where a plain
    projection would be copied into every rule of a filter.
    """
    rebuilt = [
        rebuild_timestamp(F.col(f"{s}_date_utc"), F.col(f"{s}_time_utc"), strict=False).alias(f"_{s}")
        for s in _STAMPS
    ]
    return silver.select("*", F.inline(F.array(F.struct(*rebuilt))))


def _silver_rules():
    """All rules over Silver with its rebuilt stamps."""
    text = lambda s: F.col(f"{s}_date_utc")
    malformed = [~is_text_date(text(s)) for s in _STAMPS] + [F.col("loaded_time_utc").isNull()]
    impossible = [
        text(s).isNotNull() & F.col(f"{s}_time_utc").isNotNull() & F.col(f"_{s}").isNull()
        for s in _STAMPS
    ]
    return {
        "date text": reduce(or_, malformed),
        "impossible date": reduce(or_, impossible),
    } | _event_rules("_event", "_producer")


def _named(rules):
    """The names of the broken rules of a row, as an array."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def silver_violations(silver):
    """Silver rows that break a row rule, with the list of `rules` they break.

    Only offending rows, which a plain filter finds, get a list built.
    """
    rules = _silver_rules()
    shown = {"event_time_utc": F.col("_event"), "producer_time_utc": F.col("_producer")}
    return (
        _with_stamps(silver)
        .filter(reduce(or_, rules.values()))
        .select(*[shown.get(c, F.col(c)).alias(c) for c in BUSINESS_COLUMNS], _named(rules).alias("rules"))
    )


def require_rows(silver):
    """Stop on any broken row rule; all rules are counted in one pass over the rows."""
    rules = _silver_rules()
    counts = (
        _with_stamps(silver)
        .agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
        .first()
        .asDict()
    )
    broken = {rule: n for rule, n in counts.items() if n}
    if broken:
        raise QualityError(broken)


def duplicate_keys(frame, *key):
    """Key values that occur more than once, with their number of rows."""
    return frame.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def order_rules(events):
    """Per order: attribute conflict, payments and refunds."""
    return order_rollup(events).select("order_id", "attributes_conflict", "payments", "refunds")


BAD_PAYMENTS = "payments > 1 or refunds > 1 or (refunds > 0 and payments = 0)"


def order_attribute_conflicts(events):
    """Orders whose events disagree on customer, product, amounts or channel."""
    return order_rules(events).filter("attributes_conflict").select("order_id")


def payment_pattern_violations(events):
    """Orders with two payments, two refunds, or a refund without payment."""
    return order_rules(events).filter(BAD_PAYMENTS).select("order_id", "payments", "refunds")


def bronze_conflicts(bronze):
    """Events that occur in Bronze with more than one content."""
    versions = with_digest(comparable_bronze(bronze), _CONTENT).groupBy("event_id")
    return versions.agg(several().alias("conflict")).filter("conflict").select("event_id")


_CONTENT = [c for c in BUSINESS_COLUMNS if c != "event_id"]


def event_audit(events, bronze):
    """Per event id, Silver against Bronze, in one shuffle of ids and digests.

    With one Silver row per id and one Bronze content per id, the two tables are equal
    as sets exactly when every id is on both sides with a single content. Rows move as they are:
    few ids repeat within a task, and the state of an id is three times as wide as its digest.
    """
    side = lambda frame, silver: with_digest(frame, _CONTENT).select(
        "event_id", *DIGEST, F.lit(silver).alias("silver")
    )
    silver = F.col("silver")
    return (
        side(events, True)
        .unionByName(side(comparable_bronze(bronze), False))
        .repartition("event_id")
        .groupBy("event_id")
        .agg(
            F.count_if(silver).alias("silver_rows"),
            F.count_if(~silver).alias("bronze_rows"),
            several(~silver).alias("bronze_conflict"),
            unlike(silver, ~silver).alias("differs"),
        )
    )


def require_events(silver, bronze):
    """Stop unless every Silver row is valid and Silver equals Bronze.

    Returns the number of unique events and of Bronze rows.
    """
    require_rows(silver)
    events = events_from_silver(silver)
    audit = (
        event_audit(events, bronze)
        .agg(
            F.count_if(F.col("silver_rows") > 0).alias("events"),
            F.coalesce(F.sum("bronze_rows"), F.lit(0)).alias("bronze_rows"),
            F.count_if(F.col("silver_rows") > 1).alias("duplicate event_id"),
            F.count_if("bronze_conflict").alias("conflicting Bronze versions"),
            F.count_if("differs").alias("Bronze/Silver reconciliation"),
        )
        .first()
        .asDict()
    )
    report = {"events": audit.pop("events"), "bronze_rows": audit.pop("bronze_rows")}
    if not report["events"]:
        raise QualityError({"empty Silver": 1})
    # Reported alone, as they also show up as differences.
    for rule in ("duplicate event_id", "conflicting Bronze versions"):
        if audit[rule]:
            raise QualityError({rule: audit[rule]})
    if audit["Bronze/Silver reconciliation"]:
        raise QualityError(audit)
    return report


def require_source(silver, bronze):
    """Stop unless Silver may be loaded: `require_events` and the rules over orders.

    Returns the pass report: unique events, orders and Bronze rows.
    """
    report = require_events(silver, bronze)
    report["orders"] = require_orders(order_rules(events_from_silver(silver)))
    return report


def require_order_sums(conflicts, bad_payments):
    """Stop when orders have conflicting attributes or a wrong payment pattern."""
    found = {"order attributes conflict": conflicts, "payment/refund pattern": bad_payments}
    broken = {rule: n for rule, n in found.items() if n}
    if broken:
        raise QualityError(broken)


def require_orders(states):
    """The same over order states; returns the order count."""
    sums = states.agg(
        F.count("*").alias("orders"),
        F.count_if("attributes_conflict").alias("conflicts"),
        F.count_if(F.expr(BAD_PAYMENTS)).alias("bad_payments"),
    ).first()
    require_order_sums(sums["conflicts"], sums["bad_payments"])
    return sums["orders"]


def _inbox_rules():
    """The basic checks before Silver; the producer time may still be missing."""
    blank = lambda c: blank_to_null(F.col(c)).isNull()
    return {
        "event_id": blank("event_id"),
        "order_id": blank("order_id"),
        "event_type": blank("event_type"),
        "event time": F.col("event_time_utc").isNull(),
        "quantity": _missing_or("quantity", F.col("quantity") <= 0),
        "unit price": _amount_problem("unit_price_vnd"),
        "order total": _amount_problem("order_total_vnd"),
    }


def inbox_event_violations(decoded):
    """Decoded messages that break a basic check, with the list of `rules`."""
    return decoded.withColumn("rules", _named(_inbox_rules())).filter(F.size("rules") > 0)


def require_inbox_events(decoded):
    """Stop when there is no message or one breaks a basic check."""
    rules = _inbox_rules()
    counts = (
        decoded.agg(
            F.count("*").alias("rows"),
            *[F.count_if(test).alias(name) for name, test in rules.items()],
        )
        .first()
        .asDict()
    )
    if not counts.pop("rows"):
        raise QualityError({"empty inbox": 1})
    broken = {rule: n for rule, n in counts.items() if n}
    if broken:
        raise QualityError(broken)


def screen_inbox(inbox):
    """Every message typed as far as possible, with the list of broken `rules`.

    The tolerant counterpart of decoding: nothing fails, bad values become NULL and are
    named. Split it on `size(rules) = 0` into loadable rows and a quarantine.
    """
    text = utf8_text(F.col("raw_value"), strict=False)
    payload = tolerant_json(text)
    coordinates = ["source_topic_id", "partition_id", "kafka_offset"]
    texts = inbox.select("raw_value", *coordinates, payload.alias("_p")).select(
        "raw_value",
        *coordinates,
        unread("_p").alias("_unparsed"),
        "_p.*",
    )
    typed = texts.select(
        *coordinates,
        "raw_value",
        "_unparsed",
        *typed_columns(strict=False),
    )
    rules = F.when(F.col("_unparsed"), F.array(F.lit("json"))).otherwise(_named(_event_rules()))
    return typed.withColumn("rules", rules).drop("_unparsed")


def null_profile(silver):
    """Rows without a value, per required field."""
    fields = {
        "null_event_id": "event_id",
        "null_order_id": "order_id",
        "null_event_type": "event_type",
        "null_event_date": "event_date_utc",
        "null_event_time": "event_time_utc",
    }
    return silver.agg(*[F.count_if(F.col(c).isNull()).alias(a) for a, c in fields.items()])


def duplicate_count(frame, key="event_id"):
    """Rows, and how many of them repeat a key."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("rows"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        (F.coalesce(F.sum("rows"), F.lit(0)) - F.count(key)).alias("duplicate_rows"),
    )


def number_violations(silver):
    """Rows with a quantity of zero or less or a negative amount."""
    return silver.filter("quantity <= 0 or unit_price_vnd < 0 or order_total_vnd < 0")


def lost_in_join(rows, dim, *key):
    """Rows without a partner in the dimension."""
    return rows.join(dim.select(*key), [*key], "left_anti")


def orphan_keys(fact, links):
    """Key values of the fact without a dimension row, ignoring NULL keys.

    `links` maps a fact column to (dimension, dimension column). Distinct keys are taken
    before the join, so a frequent key costs one row.
    """
    found = None
    for column, (dim, dim_key) in links.items():
        used = fact.select(F.col(column).cast("long").alias("key_value")).filter(
            "key_value is not null"
        )
        known = dim.select(F.col(dim_key).cast("long").alias("key_value"))
        lost = (
            used.groupBy("key_value")
            .agg(F.count("*").alias("rows"))
            .join(known, "key_value", "left_anti")
            .select(F.lit(column).alias("key_column"), "key_value", "rows")
        )
        found = lost if found is None else found.unionByName(lost)
    return found


def order_count_check(silver, fact_orders):
    """Orders in Silver next to rows in fact_orders."""
    return one_row(
        silver.agg(F.count_distinct("order_id").alias("silver_orders")),
        fact_orders.agg(F.count("*").alias("fact_orders")),
    )


def payment_crosscheck(metrics, silver):
    """Gross and refunded sums next to the same sums taken from the events."""
    of_type = lambda t: F.sum(
        F.when(F.col("event_type") == t, F.col("order_total_vnd"))
    )
    return one_row(
        metrics.agg(
            F.sum("gross_paid_vnd").alias("gross_paid_vnd"),
            F.sum("refunded_vnd").alias("refunded_vnd"),
        ),
        silver.agg(
            of_type("PAYMENT_CONFIRMED").alias("event_paid_vnd"),
            of_type("REFUND_ISSUED").alias("event_refunded_vnd"),
        ),
    )


def one_row(*frames):
    """Single-row frames side by side."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
