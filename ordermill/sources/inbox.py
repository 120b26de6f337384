"""The raw message inbox: exact bytes, keyed by source coordinates, append-only."""

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ordermill.functions.digest import DIGEST, several, with_digest
from ordermill.operators.parse import offset_span
from ordermill.schemas import INBOX, INBOX_CONTENT, INBOX_KEY
from ordermill.sources.messages import project_message
from ordermill.sources.store import read_or_empty

_STORED = [f.name for f in INBOX if f.name != "ingested_at"]


@dataclass(frozen=True)
class AppendResult:
    read: int
    inserted: int

    @property
    def already_present(self):
        return self.read - self.inserted


def as_inbox_rows(messages, cluster, topic_id):
    """Kafka-shaped messages with their source identity; no `ingested_at` yet."""
    return project_message(messages).select(
        F.lit(cluster).alias("source_cluster"),
        F.lit(topic_id).alias("source_topic_id"),
        "topic",
        F.col("partition").alias("partition_id"),
        F.col("offset").alias("kafka_offset"),
        F.col("key").alias("message_key"),
        F.col("value").alias("raw_value"),
        "kafka_timestamp_ms",
    )


def compare_with_inbox(batch, inbox):
    """One row per coordinate of the batch: copies, known or not, conflict or not.

    A coordinate conflicts when its contents differ, between batch and inbox or within the batch.
    Both sides meet in one shuffle of coordinates and digests, combined before it; no content moves.
    """
    side = lambda rows, copies: with_digest(rows, INBOX_CONTENT).select(
        *INBOX_KEY, *DIGEST, F.lit(copies).alias("copies")
    )
    return (
        side(batch, 1)
        .unionByName(side(inbox, 0))
        .groupBy(*INBOX_KEY)
        .agg(
            F.sum("copies").alias("copies"),
            F.bool_or(F.col("copies") == 0).alias("known"),
            several().alias("conflict"),
        )
        .filter("copies > 0")
    )


def inbox_conflicts(batch, inbox):
    """Coordinates of the batch whose content differs from what is stored."""
    return compare_with_inbox(batch, inbox).filter("conflict").select(*INBOX_KEY)


def _absent_rows(batch, compared):
    """Batch rows at coordinates that are not stored, one for each; those that came once are not sorted out."""
    new = compared.filter("not known").select(*INBOX_KEY, "copies")
    rows = batch.select(*_STORED).join(new, INBOX_KEY)
    once, more = rows.filter("copies = 1"), rows.filter("copies > 1")
    return once.unionByName(more.dropDuplicates(INBOX_KEY)).select(*_STORED)


def new_inbox_rows(batch, inbox):
    """Batch rows whose coordinates are not stored yet, one per coordinate."""
    return _absent_rows(batch, compare_with_inbox(batch, inbox))


def _spans(batch):
    """A scan filter: for each source partition of the batch, its own offsets only.

    Offsets of different partitions have nothing to do with each other. There is one term for
    each partition of the topic.
    """
    source = [c for c in INBOX_KEY if c != "kafka_offset"]
    spans = batch.groupBy(*source).agg(F.min("kafka_offset").alias("low"), F.max("kafka_offset").alias("high"))
    test = F.lit(False)
    for span in spans.collect():
        place = F.col("kafka_offset").between(span["low"], span["high"])
        for column in source:
            place = place & F.col(column).eqNullSafe(F.lit(span[column]))
        test = test | place
    return test


def append_inbox(spark, batch, path, topic):
    """Append what is new in `batch`; an invalid batch raises and writes nothing.

    Stored rows are looked up only in the offset span of the batch, partition by partition,
    so the files outside of it are skipped. Rerunning a batch adds nothing, also after a lost
    commit. The batch is read four times, so a caller whose source is slow should persist it.
    """
    checked = None
    try:
        seen = batch.agg(
            F.count("*").alias("read"),
            F.count_if(~F.col("topic").eqNullSafe(F.lit(topic))).alias("foreign"),
            F.count_if((F.col("partition_id") < 0) | (F.col("kafka_offset") < 0)).alias("bad"),
        ).first()
        if seen["read"] == 0:
            return AppendResult(0, 0)
        if seen["foreign"]:
            raise ValueError(f"{seen['foreign']} rows come from a topic other than {topic}")
        if seen["bad"]:
            raise ValueError("Negative partition or offset in batch")
        inbox = read_or_empty(spark, path, INBOX).filter(_spans(batch))
        checked = compare_with_inbox(batch, inbox).persist(StorageLevel.MEMORY_AND_DISK)
        state = checked.agg(
            F.count_if("conflict").alias("conflicts"), F.count_if(~F.col("known")).alias("new")
        ).first()
        if state["conflicts"]:
            raise ValueError(f"{state['conflicts']} coordinates hold a second, different message")
        if state["new"]:
            rows = _absent_rows(batch, checked).withColumn("ingested_at", F.current_timestamp())
            rows.select(*INBOX.names).write.mode("append").parquet(path)
        return AppendResult(seen["read"], state["new"])
    finally:
        if checked is not None:
            checked.unpersist()


def invalid_inbox_keys(inbox):
    """Rows that break the inbox key: negative or missing parts, or a repeated coordinate."""
    any_null = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(True)) for c in [*INBOX_KEY, "topic"]])
    return (
        inbox.select(
            *INBOX_KEY,
            F.when(any_null, "missing key part")
            .when(F.col("partition_id") < 0, "negative partition")
            .when(F.col("kafka_offset") < 0, "negative offset")
            .alias("problem"),
        )
        .groupBy(*INBOX_KEY)
        .agg(F.max("problem").alias("problem"), F.count("*").alias("copies"))
        .withColumn(
            "problem",
            F.coalesce("problem", F.when(F.col("copies") > 1, F.lit("repeated coordinate"))),
        )
        .filter("problem is not null")
    )


def inbox_coverage(inbox):
    """Rows and offset range per topic identity, topic and partition."""
    return inbox.groupBy("source_topic_id", "topic", "partition_id").agg(*offset_span("kafka_offset"))


def latest_messages(inbox, rows=5):
    """The newest stored messages as text."""
    order = [F.desc("ingested_at"), *[F.desc(c) for c in INBOX_KEY]]
    return (
        inbox.orderBy(*order)
        .limit(rows)
        .select(
            "partition_id",
            "kafka_offset",
            F.decode("message_key", "UTF-8").alias("order_key"),
            F.decode("raw_value", "UTF-8").alias("raw_json"),
        )
    )
