"""Watching a message stream without storing it."""

from pyspark.storagelevel import StorageLevel

from ordermill.operators.parse import batch_summary, message_text, parse_events
from ordermill.session import use_utc

INSPECT_TRIGGER = "5 seconds"
# The fields of a sample.
SHOWN = [
    "event_id",
    "order_id",
    "event_type",
    "quantity",
    "order_total_vnd",
    "event_time_utc",
    "json_parse_error",
]


def start_inspection(spark, source, checkpoint, report, once=False):
    """Call `report(batch_id, per-partition summary rows, five sample rows)` per batch.

    Every message is parsed and counted; only one line per partition and the samples
    reach the driver.
    """
    parsed = parse_events(message_text(source.stream(use_utc(spark))))

    def inspect(batch, batch_id):
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # parsed once for both reports
        try:
            summary = batch_summary(batch).orderBy("partition").collect()
            report(batch_id, summary, batch.select(*SHOWN).limit(5).collect())
        finally:
            batch.unpersist()

    return _start(parsed, inspect, checkpoint, once)


def start_kept_inspection(spark, source, checkpoint, path, once=False):
    """Keep the summary of each batch as a table, one row for each batch and source partition.

    A batch that is run again after a failure replaces its own folder, so it counts once.
    """
    parsed = parse_events(message_text(source.stream(use_utc(spark))))

    def keep(batch, batch_id):
        batch_summary(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(parsed, keep, checkpoint, once)


def _start(parsed, each, checkpoint, once):
    trigger = {"availableNow": True} if once else {"processingTime": INSPECT_TRIGGER}
    return (
        parsed.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
