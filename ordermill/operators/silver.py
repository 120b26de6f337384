"""Decode, type, deduplicate and store the cleaned event table."""

import uuid

from pyspark.sql import functions as F, types as T
from pyspark.sql.window import Window

from ordermill.functions.clock import iso_timestamp, rebuild_timestamp, text_date, text_time
from ordermill.functions.rows import fail_where
from ordermill.functions.text import (
    blank_or_null_word_to_null,
    blank_to_null,
    text_to_boolean,
    utf8_text,
)
from ordermill.schemas import (
    BRONZE,
    BUSINESS_COLUMNS,
    DEFAULT_CLUSTER,
    DEFAULT_TOPIC,
    MESSAGE_JSON,
    SILVER,
    SILVER_EVENT_COLUMNS,
)
from ordermill.session import shared_folder
from ordermill.sources.store import clustered, read_or_empty

BROADCAST_KEYS = 1_000_000

_NOT_NULL = ["event_id", "order_id", "event_type", "event_time_utc"]


def _convert(column, strict):
    kind = BRONZE[column].dataType
    text = F.col(column)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampType):
        return iso_timestamp(text, strict)
    if isinstance(kind, T.BooleanType):
        return text_to_boolean(text, strict)
    return text.cast(kind) if strict else text.try_cast(kind)


def typed_columns(strict=True):
    """Text to the Bronze types. A bad value raises, or gives NULL when not strict."""
    return [_convert(c, strict).alias(c) for c in BUSINESS_COLUMNS]


def decode_inbox(inbox, cluster=DEFAULT_CLUSTER, topic=DEFAULT_TOPIC):
    """Typed events of one source with their coordinates.

    Malformed bytes, JSON or values fail the job. The JSON is parsed once per message.
    """
    chosen = inbox.filter((F.col("source_cluster") == cluster) & (F.col("topic") == topic))
    payload = F.from_json(utf8_text(F.col("raw_value")), MESSAGE_JSON, {"mode": "FAILFAST"})
    coordinates = ["source_topic_id", "partition_id", "kafka_offset"]
    return chosen.select(payload.alias("_payload"), *coordinates).select(
        "_payload.*", *coordinates
    ).select(*typed_columns(), *coordinates)


def bronze_from_inbox(inbox, cluster=DEFAULT_CLUSTER, topic=DEFAULT_TOPIC):
    """The inbox seen as Bronze rows: typed, duplicates kept, promo codes untouched."""
    return decode_inbox(inbox, cluster, topic).select(*BUSINESS_COLUMNS)


def _first_per_event(rows, *order):
    """Spark keeps one row per event and input partition before the shuffle."""
    newest = Window.partitionBy("event_id").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    )


def _promo_cleaned(rows):
    return rows.withColumn("promo_code", blank_to_null(F.col("promo_code")))


def _repeated_keys(rows):
    """Hashes of the event ids that occur more than once (and perhaps of others), kept in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/ordermill/keys/{uuid.uuid4().hex}"
    hashes = rows.groupBy(F.xxhash64("event_id").alias("_key")).agg(F.count("*").alias("_rows"))
    hashes.filter("_rows > 1").select("_key").write.parquet(path)
    return rows.sparkSession.read.schema("_key long").parquet(path)


def _newest(rows, *order):
    """One row per event, the first in `order`.

    Ids are counted by their hashes first. While those that repeat are few enough to broadcast, only
    their rows are ranked: the others stay where they are, neither sorted nor moved. Where more
    repeat, all rows are ranked. Both ways give the same rows.
    """
    repeated = _repeated_keys(rows)
    if repeated.count() > BROADCAST_KEYS:
        return _first_per_event(rows, *order)
    keyed = rows.withColumn("_key", F.xxhash64("event_id"))
    alone, several = (
        keyed.join(F.broadcast(repeated), "_key", how).drop("_key") for how in ("left_anti", "left_semi")
    )
    return alone.unionByName(_first_per_event(several, *order))


def newest_per_event(bronze):
    """One row per event: the last produced; other columns only settle ties."""
    ties = [F.desc(c) for c in BUSINESS_COLUMNS if c not in ("event_id", "producer_time_utc")]
    rows = _promo_cleaned(bronze.select(*BUSINESS_COLUMNS))
    return _newest(rows, F.desc_nulls_last("producer_time_utc"), *ties)


def newest_inbox_copy(decoded):
    """One row per event: the last produced, then by source coordinates, last offset first."""
    kept = _newest(
        _promo_cleaned(decoded),
        F.desc_nulls_last("producer_time_utc"),
        F.asc("source_topic_id"),
        F.asc("partition_id"),
        F.desc("kafka_offset"),
    )
    return kept.select(*BUSINESS_COLUMNS)


def split_datetimes(rows):
    """Both timestamps as (date text, time text) pairs, in Silver column order."""
    return rows.withColumns(
        {
            "event_date_utc": text_date("event_time_utc"),
            "producer_date_utc": text_date("producer_time_utc"),
            "event_time_utc": text_time("event_time_utc"),
            "producer_time_utc": text_time("producer_time_utc"),
        }
    ).select(*SILVER_EVENT_COLUMNS)


def with_load_metadata(rows):
    now = F.current_timestamp()
    return rows.withColumns(
        {"loaded_date_utc": text_date(now), "loaded_time_utc": text_time(now)}
    )


def insert_absent(target, source, key="event_id", small_source=False):
    """Rows of `source` whose key is not in `target`.

    For a small source the target keys are first narrowed to those of the source, which
    is then the side that moves; the large target is filtered where it lies.
    """
    known = target.select(key)
    if small_source:
        known = known.join(source.select(key), key, "left_semi")
    return source.join(known, key, "left_anti")


def append_silver(spark, rows, path, small_source=False):
    """Append Silver-shaped rows with new ids; existing rows are never changed."""
    known = read_or_empty(spark, path, SILVER)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in _NOT_NULL])
    rows = fail_where(
        rows, F.when(missing != "", F.concat(F.lit("Silver needs a value in: "), missing))
    )
    fresh = with_load_metadata(insert_absent(known, rows, small_source=small_source))
    clustered(fresh, "event_date_utc").write.mode("append").parquet(path)
    return read_or_empty(spark, path, SILVER)


def silver_from_bronze(spark, bronze, path):
    """Bring Silver up to date with a Bronze table."""
    return append_silver(spark, split_datetimes(newest_per_event(bronze)), path)


def _stored(rows):
    """The rows written to the shared folder, as they are read several times and dear to make."""
    path = f"{shared_folder(rows.sparkSession)}/ordermill/decoded/{uuid.uuid4().hex}"
    rows.write.parquet(path, compression="zstd")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def silver_from_inbox(spark, inbox, path, cluster=DEFAULT_CLUSTER, topic=DEFAULT_TOPIC):
    """Bring Silver up to date with the inbox; invalid messages stop the load."""
    from ordermill.operators.quality import require_inbox_events

    decoded = _stored(decode_inbox(inbox, cluster, topic))
    require_inbox_events(decoded)
    return append_silver(spark, split_datetimes(newest_inbox_copy(decoded)), path)


def events_from_silver(silver, strict=True):
    """Silver with both timestamps rebuilt and promo codes in their final form."""
    return silver.select(
        *[
            rebuild_timestamp(
                F.col(c.replace("time", "date")), F.col(c), strict
            ).alias(c)
            if c in ("event_time_utc", "producer_time_utc")
            else blank_or_null_word_to_null(F.col(c)).alias(c)
            if c == "promo_code"
            else F.col(c)
            for c in BUSINESS_COLUMNS
        ]
    )


def comparable_bronze(bronze):
    """Bronze in the form Silver is compared with; duplicates kept."""
    return bronze.select(*BUSINESS_COLUMNS).withColumn(
        "promo_code", blank_or_null_word_to_null(F.col("promo_code"))
    )
