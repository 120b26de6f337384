"""Registered results of loads, checks and files: what a run of each leaves behind."""

from pyspark.sql import functions as F, types as T

from ordermill.operators import facts, quality, silver
from ordermill.operators.upsert import ACTIONS
from ordermill.plans import gold
from ordermill.plans.layers import Layers, scratch, silver_rows
from ordermill.schemas import BUSINESS_COLUMNS, SILVER_EVENT_COLUMNS
from ordermill.sources import delimited, derived
from ordermill.sources.inbox import invalid_inbox_keys
from ordermill.sources.store import VersionedTables


def _number(column="event_id"):
    return F.substring(column, -15, 15).cast("long")


def _fact_actions(spark, load, actions):
    rows = [(load, name, *[actions[name][a] for a in ACTIONS]) for name in ("fact_sales_events", "order_states")]
    return spark.createDataFrame(rows, "load string, table_name string, " + ", ".join(f"`{a}` long" for a in ACTIONS))


def _damage(store, name, column, where, value):
    """Publish a fact with another value in some of its rows."""
    table = gold.parted(store)[name]
    rows = table.read()
    _, folders = table.stage(rows.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column))))
    store.publish(parts={name: table.replaced(folders, table.keys())})


def gold_load_actions(spark, sf_dir):
    """Rows per action of facts: a first load, one that changes nothing, repairs of wrong and of lost values.

    The row `pending` is what a load would do to facts in which values are wrong again, without doing it.
    """
    store = VersionedTables(spark, f"{scratch(spark)}/gold")
    source, bronze = Layers(spark, sf_dir).silver(), derived.raw_sales(spark, sf_dir)
    load = lambda name: _fact_actions(spark, name, gold.build_gold(store, source, bronze).actions)
    done = load("first").unionByName(load("unchanged"))
    _damage(store, "fact_sales_events", "city", _number() % 400 == 1, "WRONG")
    _damage(store, "order_states", "latest_event_type", _number("order_id") % 300 == 1, "WRONG")
    done = done.unionByName(load("repaired"))
    _damage(store, "fact_sales_events", "traffic_source", _number() % 400 == 2, None)
    _damage(store, "order_states", "city", _number("order_id") % 300 == 2, None)
    done = done.unionByName(_fact_actions(spark, "pending", gold.pending_changes(store, source)))
    return done.unionByName(load("null_changed"))


def load_report(spark, sf_dir):
    """The pass report of the source checks."""
    found = quality.require_source(Layers(spark, sf_dir).silver(), derived.raw_sales(spark, sf_dir))
    return spark.createDataFrame([tuple(found[c] for c in ("events", "bronze_rows", "orders"))], "events long, bronze_rows long, orders long")


def _loaded(rows):
    """Silver with whether its load time is a moment of today or yesterday, in place of that time."""
    at = F.try_to_timestamp(F.concat_ws(" ", "loaded_date_utc", "loaded_time_utc"), F.lit("yyyyddMM HH:mm:ss.SSSSSS"))
    recent = at.between(F.current_timestamp() - F.expr("interval 1 day"), F.current_timestamp())
    return rows.select(*SILVER_EVENT_COLUMNS, recent.alias("loaded"))


def silver_load(spark, sf_dir):
    """Silver after a load of on-time events and another of all."""
    path, bronze = f"{scratch(spark)}/silver", derived.raw_sales(spark, sf_dir)
    silver.silver_from_bronze(spark, bronze.filter("not is_late_event"), path)
    return _loaded(silver.silver_from_bronze(spark, bronze, path))


def silver_load_from_inbox(spark, sf_dir):
    """The same from inbox messages."""
    path, messages = f"{scratch(spark)}/silver", derived.inbox(spark, sf_dir)
    silver.silver_from_inbox(spark, messages.filter("kafka_offset % 4 = 0"), path)
    return _loaded(silver.silver_from_inbox(spark, messages, path))


def _csv(rows, path):
    rows.write.options(**delimited.DIALECT, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", emptyValue='""').csv(path)


def csv_taken_once(spark, sf_dir):
    """Rows of a CSV folder that was delivered, delivered again, and got more files; with the part each came in."""
    root = scratch(spark)
    rows = derived.raw_sales(spark, sf_dir, "k")
    for part in range(2):
        _csv(rows.filter(F.col("k") % 2 == part).drop("k"), f"{root}/in/{part}")
        for _ in range(2):
            taken = delimited.ingest_csv_once(spark, f"{root}/in/*", f"{root}/bronze", f"{root}/state", with_source=True)
    part = F.regexp_extract("source_file", r"/in/(\d)/", 1).cast("int")
    return taken.select(*BUSINESS_COLUMNS, part.alias("part"))


def csv_rejects(spark, sf_dir):
    """Rows by the reason for which a scan rejects them: too few or too many fields, blank ids."""
    path, slot = f"{scratch(spark)}/in", F.col("n") % 401
    rows = derived.raw_sales(spark, sf_dir, "n").select(*[F.col(c).cast("string").alias(c) for c in BUSINESS_COLUMNS], "n")
    rows = rows.withColumns(
        {
            "event_id": F.when(slot == 3, " ").otherwise(F.col("event_id")),
            "order_id": F.when(slot.isin(4, 5), "").otherwise(F.col("order_id")),
        }
    )
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*BUSINESS_COLUMNS), kept)
    line = F.when(slot == 1, F.regexp_replace(line, ",[^,]*$", "")).when(slot == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # each task writes one file
    header = ",".join(BUSINESS_COLUMNS) + "\n"
    rows.select(F.when(first, F.concat(F.lit(header), line)).otherwise(line)).write.text(path)
    return delimited.scan_csv(spark, path).groupBy("reject_reason").agg(F.count("*").alias("rows"))


def _exported(spark, sf_dir):
    """The six tables of the dashboard from the layers, written; folder, and name to (schema, sort key)."""
    layers, folder = Layers(spark, sf_dir), scratch(spark)
    tables = {
        "dim_date": (layers.dim_date(), "date_key"),
        "dim_customer": (layers.dim_customer(), "customer_key"),
        "dim_product": (layers.dim_product(), "product_key"),
        "fact_sales_events": (layers.fact_sales_events(), "event_id"),
        "fact_orders": (facts.fact_orders(layers.order_states()), "order_id"),
        "order_payment_metrics": (facts.payment_metrics(layers.order_states()), "order_id"),
    }
    delimited.export_snapshot(tables, folder)
    return folder, {name: (frame.schema, key) for name, (frame, key) in tables.items()}


def _read_export(spark, folder, name, schema):
    texts = T.StructType([T.StructField(c, T.StringType()) for c in schema.names])
    return spark.read.schema(texts).options(**delimited.DIALECT).csv(f"{folder}/{name}")


def exported_gold(spark, sf_dir):
    """Every row of the six exported tables as the text that its file holds."""
    folder, tables = _exported(spark, sf_dir)
    found = None
    for name, (schema, _) in tables.items():
        fields = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("-")) for c in schema.names])
        rows = _read_export(spark, folder, name, schema).select(F.lit(name).alias("table_name"), fields.alias("fields"))
        found = rows if found is None else found.unionByName(rows)
    return found


def export_order(spark, sf_dir):
    """Per exported table its rows, and whether they are in order, in each file and from file to file."""
    folder, tables = _exported(spark, sf_dir)
    found = None
    for name, (schema, key) in tables.items():
        rows = _read_export(spark, folder, name, schema)
        row = delimited.export_order(rows, F.col(key).cast(schema[key].dataType)).select(F.lit(name).alias("table_name"), "*")
        found = row if found is None else found.unionByName(row)
    return found


def inbox_rule_violations(spark, sf_dir):
    """Decoded messages with defects that break a basic check before Silver."""
    events = silver.events_from_silver(derived.with_defects(silver_rows(spark, sf_dir)), strict=False)
    return quality.inbox_event_violations(events).select("event_id", "rules")


def inbox_key_violations(spark, sf_dir):
    """Coordinates that cannot be: negative or missing parts, and those that occur twice."""
    n = F.col("kafka_offset")
    rows = derived.inbox(spark, sf_dir).withColumns(
        {
            "partition_id": F.when(n % 1000 == 2, -1).when(n % 1000 == 4, None).otherwise(F.col("partition_id")),
            "kafka_offset": F.when(n % 1000 == 6, -n).otherwise(n),
        }
    )
    twice = rows.filter("kafka_offset % 1000 = 8")
    return invalid_inbox_keys(rows.unionByName(twice)).select("partition_id", "kafka_offset", "problem", "copies")


def lost_in_join(spark, sf_dir):
    """Events without a product when clearance products are missing from the dimension."""
    layers = Layers(spark, sf_dir)
    known = layers.dim_product().filter("category <> 'CLEARANCE'")
    return quality.lost_in_join(layers.events(), known, "product_id", "category").select("event_id", "product_id", "category")


def loaded_date_violations(spark, sf_dir):
    """Silver rows whose load date is no date, or none of the calendar."""
    n = _number()
    rows = silver_rows(spark, sf_dir).withColumn(
        "loaded_date_utc",
        F.when(n % 307 == 1, "20263102").when(n % 307 == 2, "2026-1-2").when(n % 307 == 3, None).otherwise(F.lit("20260102")),
    )
    return quality.silver_violations(rows).select("event_id", "rules")


QUERIES = [
    gold_load_actions,
    load_report,
    silver_load,
    silver_load_from_inbox,
    csv_taken_once,
    csv_rejects,
    exported_gold,
    export_order,
    inbox_rule_violations,
    inbox_key_violations,
    lost_in_join,
    loaded_date_violations,
]
