"""Calendar, customer and product dimensions."""

import uuid

from pyspark.sql import functions as F

from ordermill.functions.clock import date_key, iso_weekday, text_date
from ordermill.schemas import DIM_DATE
from ordermill.session import shared_folder

_ROW_BITS = 33


def dim_date(events, known=None):
    """Every day from the first event to the last event or producer date.

    With `known`, an earlier calendar, its span is covered as well.
    """
    span = events.agg(
        F.to_date(F.min("event_time_utc")).alias("first"),
        F.to_date(F.greatest(F.max("event_time_utc"), F.max("producer_time_utc"))).alias("last"),
    )
    if known is not None:
        earlier = known.agg(F.min("full_date").alias("first"), F.max("full_date").alias("last"))
        span = span.unionByName(earlier).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    day = F.col("full_date")
    return (
        span.filter("first is not null")
        .select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("full_date"))
        .select(
            date_key(day).alias("date_key"),
            "full_date",
            text_date(day).alias("date_label"),
            F.dayofmonth(day).alias("day_of_month"),
            F.month(day).alias("month_number"),
            F.quarter(day).alias("quarter_number"),
            F.year(day).alias("year_number"),
            iso_weekday(day).alias("day_of_week"),
            (iso_weekday(day) >= 6).alias("is_weekend"),
        )
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DIM_DATE])
    )


def new_dim_rows(dim, source, business_key, key):
    """Rows for the business keys of `source` that `dim` lacks.

    Keys continue after the greatest one, without gaps, in business-key order. The new
    keys are range-sorted and written to the shared folder, so that every pass sees the
    same partitions; the key is then the rows in earlier partitions plus the position in
    the own one. No task
    holds more than one range, and only the per-partition counts are put together.
    """
    return number_new_keys(dim, source, business_key, key)[0]


def number_new_keys(dim, source, business_key, key):
    """`new_dim_rows`, and how many they are."""
    spark = source.sparkSession
    start = dim.agg(F.max(key)).first()[0]
    fresh = source.select(*business_key).distinct()
    if start is not None:
        fresh = fresh.join(dim.select(*business_key), business_key, "left_anti")
    path = f"{shared_folder(spark)}/ordermill/keys/{uuid.uuid4().hex}"
    (
        fresh.repartitionByRange(*business_key)
        .sortWithinPartitions(*business_key)
        .withColumn("_id", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    placed = spark.read.parquet(path).select(
        *business_key,
        F.shiftright("_id", _ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )
    # One entry per partition of the sort, whatever the number of rows.
    counts = placed.groupBy("_part").agg(F.max("_row").alias("last")).collect()
    before, offsets = start or 0, []
    for part, last in sorted(counts):
        offsets.append((part, before))
        before += last + 1
    bases = spark.createDataFrame(offsets, "_part long, _base long")
    rows = placed.join(F.broadcast(bases), "_part").select(
        (F.col("_base") + F.col("_row") + 1).alias(key), *business_key
    )
    return rows, before - (start or 0)


def extend_dim(dim, source, business_key, key):
    """`dim` with the unseen business keys of `source` appended; known keys stay."""
    return dim.unionByName(new_dim_rows(dim, source, business_key, key))


CUSTOMER = (["customer_id"], "customer_key")
PRODUCT = (["product_id", "category"], "product_key")
