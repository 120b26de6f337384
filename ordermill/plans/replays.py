"""Registered results of streams over the derived messages, delivered part by part.

A delivery is a folder of files; the stream is run until it has taken it and then stopped, so
every delivery is also a restart on the same checkpoint, at any number of files.
"""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ordermill.operators import facts
from ordermill.plans.gold import gold_tables
from ordermill.plans.layers import scratch
from ordermill.schemas import BUSINESS_COLUMNS, DEFAULT_CLUSTER, DEFAULT_TOPIC
from ordermill.sources import derived
from ordermill.sources.messages import MessageFolder
from ordermill.streaming import ingest, inspect, windows

_FILES = 100_000  # more files than a delivery has: each is one trigger


def _destination(root):
    return ingest.Destination(f"{root}/lake", DEFAULT_CLUSTER, DEFAULT_TOPIC, derived.TOPIC_ID)


def _kept(spark, rows, root):
    """Rows with their `delivery`, written once, so that all deliveries come from one computation."""
    rows.write.partitionBy("delivery").parquet(f"{root}/sent")
    return spark.read.parquet(f"{root}/sent")


def _each(rows, root, run, name="topic"):
    """Put one delivery after the other into the topic folder and call `run` with its number."""
    for number in range(derived.DELIVERIES):
        part = rows.filter(F.col("delivery") == number).drop("delivery")
        part.write.parquet(f"{root}/{name}/{number}")
        run(number)


def _messages(spark, sf_dir, root, damage=False):
    return _kept(spark, derived.deliveries(derived.messages(spark, sf_dir, damage)), root)


def _topic(root):
    return MessageFolder(f"{root}/topic/*", max_per_batch=_FILES)


def _ingest(spark, root, to, **options):
    ingest.start_ingest(
        spark, _topic(root), to, f"{root}/state", "backfill", report=lambda text: None, **options
    ).awaitTermination()


def _orders(spark, to):
    return facts.fact_orders(gold_tables(to.gold(spark))["order_states"])


def streamed_orders(spark, sf_dir):
    """Orders after four batches with late, repeated and old-order messages."""
    root = scratch(spark)
    to, sent = _destination(root), _messages(spark, sf_dir, root)
    _each(sent, root, lambda number: _ingest(spark, root, to))
    return _orders(spark, to)


class Stop(RuntimeError):
    """A batch that was made to stop."""


def restarted_orders(spark, sf_dir):
    """Orders after two deliveries whose batches were stopped: after the inbox, after Silver, after Gold."""
    root = scratch(spark)
    rows = derived.deliveries(derived.messages(spark, sf_dir))
    sent = _kept(spark, rows.withColumn("delivery", F.least("delivery", F.lit(1))), root)
    to, stops = _destination(root), {0: ["inbox", "silver"], 1: ["gold"]}

    def run(number):
        for last in stops.get(number, []):
            _stopped(lambda stop: _ingest(spark, root, to, after=stop), last)
        _ingest(spark, root, to)

    _each(sent, root, run)
    return _orders(spark, to)


def _stopped(ingest_until, last):
    """Run an ingest that is made to stop after a step."""

    def stop(step):
        if step == last:
            raise Stop(f"stopped after {step}")

    try:
        ingest_until(stop)
    except StreamingQueryException as error:
        if f"stopped after {last}" not in str(error):
            raise
    else:
        raise AssertionError(f"no batch was stopped after {last}")


def inspected_batches(spark, sf_dir):
    """What watching the damaged topic reports: one row for each batch and partition."""
    root = scratch(spark)
    sent = _messages(spark, sf_dir, root, damage=True)

    def run(number):
        watch = inspect.start_kept_inspection(spark, _topic(root), f"{root}/state", f"{root}/seen", once=True)
        watch.awaitTermination()

    _each(sent, root, run)
    return spark.read.parquet(f"{root}/seen")


def streamed_type_windows(spark, sf_dir):
    """Closed windows by event type of the messages, in append mode, delivered in the order of years."""
    root = scratch(spark)
    messages = derived.messages(spark, sf_dir)
    year = F.year(F.get_json_object(F.col("value").cast("string"), "$.event_time_utc").cast("timestamp"))
    number = F.floor((year - derived.FIRST_YEAR) / derived.YEARS).cast("int")
    sent = _kept(spark, messages.withColumn("delivery", number), root)

    def run(number):
        stream = windows.message_windows(
            _topic(root).stream(spark), DEFAULT_CLUSTER, DEFAULT_TOPIC, derived.TOPIC_ID
        )
        writer = stream.writeStream.format("parquet").option("path", f"{root}/windows")
        writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    _each(sent, root, run)
    return spark.read.parquet(f"{root}/windows")


def _arriving(spark, sf_dir):
    """Raw events with the time they arrive: most copies within the delay, every fourth 900 days later."""
    rows = derived.raw_sales(spark, sf_dir, "n", "cp").withColumn("arrived_at", F.col("producer_time_utc"))
    wait = F.when(F.col("n") % 4 == 0, F.lit(900 * 86400)).otherwise(F.lit(300))
    later = F.timestamp_micros(F.unix_micros("arrived_at") + wait.cast("long") * 1_000_000)
    rows = rows.withColumn("arrived_at", F.when(F.col("cp") == 1, later).otherwise(F.col("arrived_at")))
    number = F.floor((F.year("arrived_at") - derived.FIRST_YEAR) / derived.YEARS).cast("int")
    return rows.select(*BUSINESS_COLUMNS, "arrived_at", number.alias("delivery"))


def _event_stream(spark, root, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", _FILES)
    return reader.parquet(f"{root}/topic/*")


def streamed_dedupe(spark, sf_dir):
    """Events kept once by the state store, and by their id where a copy comes after its state is gone."""
    root = scratch(spark)
    sent = _kept(spark, _arriving(spark, sf_dir), root)
    schema = sent.drop("delivery").schema

    def run(number):
        stream = _event_stream(spark, root, schema)
        windows.start_distinct_store(
            stream, f"{root}/stored", f"{root}/state", "arrived_at", availableNow=True
        ).awaitTermination()

    _each(sent, root, run)
    return spark.read.schema(schema).parquet(f"{root}/stored").select(*BUSINESS_COLUMNS)


def late_rows(spark, sf_dir):
    """Events read, accepted and dropped as late in each delivery, as a listener reports them."""
    root = scratch(spark)
    rows = derived.raw_sales(spark, sf_dir, "n", "cp").filter("cp = 0")
    rows = derived.deliveries(rows, "event_time_utc", "n", "cp").select("event_id", "event_time_utc", "delivery")
    sent = _kept(spark, rows, root)
    schema = sent.drop("delivery").schema
    found = []

    def run(number):
        name = f"late-{root.rsplit('/', 1)[-1]}-{number}"
        listener = windows.LateRows(name)
        spark.streams.addListener(listener)
        try:
            query = windows.distinct_events(_event_stream(spark, root, schema)).writeStream.queryName(name)
            query = query.format("noop").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
            query.start().awaitTermination()
            listener.wait()
        finally:
            spark.streams.removeListener(listener)
        read, dropped = (sum(r[k] for r in listener.rows) for k in (1, 2))
        found.append((number, read, read - dropped, dropped))

    _each(sent, root, run)
    return spark.createDataFrame(found, "delivery int, read long, accepted long, dropped long")


QUERIES = [streamed_orders, restarted_orders, inspected_batches, streamed_type_windows, streamed_dedupe, late_rows]
