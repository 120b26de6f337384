"""Messages to the inbox, and on to Silver and Gold, batch by batch."""

from dataclasses import astuple, dataclass, fields

from pyspark.storagelevel import StorageLevel

from ordermill.operators.quality import require_inbox_events
from ordermill.operators.silver import (
    append_silver,
    bronze_from_inbox,
    decode_inbox,
    newest_inbox_copy,
    silver_from_inbox,
    split_datetimes,
)
from ordermill.plans.gold import build_gold, merge_parts, refresh_gold
from ordermill.schemas import BUSINESS_COLUMNS, INBOX, SILVER
from ordermill.session import use_utc
from ordermill.sources.inbox import append_inbox, as_inbox_rows
from ordermill.sources.messages import preview
from ordermill.sources.store import VersionedTables, read_or_empty

STREAM_TRIGGER = "60 seconds"


@dataclass(frozen=True)
class Destination:
    """Where one source is stored. All paths must be reachable from every executor."""

    root: str
    cluster: str
    topic: str
    topic_id: str

    @property
    def inbox(self):
        return f"{self.root}/inbox"

    @property
    def silver(self):
        return f"{self.root}/silver"

    def gold(self, spark):
        return VersionedTables(spark, f"{self.root}/gold")


def claim_progress(spark, folder, to):
    """The offsets folder inside `folder`, which serves one destination for good.

    The first ingest leaves a one-row table of its destination there; a later one with any
    other column value would skip or repeat messages, so it is turned away.
    """
    given = spark.createDataFrame([astuple(to)], [f.name for f in fields(to)])
    owner = read_or_empty(spark, f"{folder}/owner", given.schema)
    if owner.isEmpty():
        given.coalesce(1).write.parquet(f"{folder}/owner")
    elif not owner.exceptAll(given).isEmpty():
        raise RuntimeError(f"{folder} keeps the progress of {owner.first()}, not of {to}")
    return f"{folder}/offsets"


def nothing(step):
    """Called after a step of a batch; a caller's own function may stop the batch there."""


def full_refresh(spark, to, after=nothing):
    """Silver and Gold from the whole inbox."""
    inbox = read_or_empty(spark, to.inbox, INBOX)
    silver = silver_from_inbox(spark, inbox, to.silver, to.cluster, to.topic)
    after("silver")
    return build_gold(to.gold(spark), silver, bronze_from_inbox(inbox, to.cluster, to.topic))


def affected_refresh(spark, to, rows, after=nothing):
    """Silver and Gold from the inbox rows of one batch; the rest is not read again.

    The messages of the batch are parsed once.
    """
    decoded = decode_inbox(rows, to.cluster, to.topic).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        require_inbox_events(decoded)
        silver = append_silver(
            spark, split_datetimes(newest_inbox_copy(decoded)), to.silver, small_source=True
        )
        after("silver")
        return refresh_gold(to.gold(spark), silver, decoded.select(*BUSINESS_COLUMNS))
    finally:
        decoded.unpersist()


def take_batch(messages, to, incremental=True, report=print, after=nothing):
    """Store one batch, then refresh Silver and Gold unless the batch was empty.

    `after` is called with the name of each finished step: inbox, silver, gold. Every step leaves out what is stored already, so a batch that is run again after a
    failure at any point ends in the same tables.
    """
    spark = messages.sparkSession
    rows = as_inbox_rows(messages, to.cluster, to.topic_id).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = append_inbox(spark, rows, to.inbox, to.topic)
        report(
            f"read={done.read}, inserted={done.inserted}, already_present={done.already_present}"
        )
        after("inbox")
        if done.read:
            if incremental:
                affected_refresh(spark, to, rows, after)
                merge_parts(to.gold(spark))
            else:
                full_refresh(spark, to, after)
            after("gold")
        return done
    finally:
        rows.unpersist()


def run_preview(spark, source, to, rows=1000, incremental=False):
    """Store a bounded sample; no checkpoint is made, so nothing counts as taken."""
    return take_batch(preview(use_utc(spark), source, rows), to, incremental)


def start_ingest(
    spark, source, to, checkpoints, mode="stream", incremental=True, report=print, after=nothing
):
    """Start the ingest query: `backfill` ends when caught up, `stream` keeps waiting.

    `checkpoints` is the folder of this one query's progress.
    """
    if mode not in ("stream", "backfill"):
        raise ValueError(f"unknown mode: {mode}")
    location = claim_progress(use_utc(spark), checkpoints, to)
    trigger = {"availableNow": True} if mode == "backfill" else {"processingTime": STREAM_TRIGGER}

    def store(batch, batch_id):
        take_batch(batch, to, incremental, lambda text: report(f"batch {batch_id}: {text}"), after)

    return (
        source.stream(spark)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", location)
        .trigger(**trigger)
        .start()
    )


def silver_table(spark, to):
    return read_or_empty(spark, to.silver, SILVER)
