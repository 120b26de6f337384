"""CSV in, messages out, CSV snapshot out."""

from pyspark.sql import Window, functions as F, types as T

from ordermill.functions.rows import fail_where
from ordermill.schemas import BRONZE
from ordermill.session import use_utc

CORRUPT = "_corrupt_record"
# Quotes inside a quoted field are doubled, and outer spaces belong to the value.
DIALECT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# An empty field is NULL, a quoted empty field is empty text; no other text means NULL.
TYPED = DIALECT | {"mode": "FAILFAST", "enforceSchema": False, "nullValue": "\0"}


def read_bronze_csv(spark, path):
    """Typed load of raw CSV with a header row; every duplicate is kept."""
    return (
        use_utc(spark)
        .read.schema(BRONZE)
        .options(**TYPED)
        .csv(path)
    )


def _checked_header(spark, path):
    first = spark.read.options(**DIALECT | {"header": False}).csv(path).first()
    names = [name.lstrip("﻿") if name else name for name in first] if first else []
    if (
        not {"event_id", "order_id"} <= set(names)
        or None in names
        or len(names) != len(set(names))
    ):
        raise ValueError(f"header without event_id or order_id, or with a repeated or empty name: {names}")
    return names


def scan_csv(spark, path):
    """All-text scan with a `reject_reason` per row, NULL on good rows.

    Blank fields stay blank: the reader gives NULL for them, which is undone here.
    """
    names = _checked_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    rows = (
        spark.read.schema(schema)
        .options(
            **DIALECT,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT,
            enforceSchema=False,
            columnPruning=False,
        )
        .csv(path)
    )
    blank = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "wrong number of fields")
        .when(blank("event_id"), "blank event_id")
        .when(blank("order_id"), "blank order_id")
    )
    return rows.select(
        *[
            F.when(F.col(CORRUPT).isNull(), F.coalesce(F.col(n), F.lit("")))
            .otherwise(F.col(n))
            .alias(n)
            for n in names
        ],
        reason.alias("reject_reason"),
    )


def strict_csv(spark, path):
    """As `scan_csv`, but the first bad row fails the job."""
    rows = scan_csv(spark, path)
    text = F.concat(F.lit("CSV row refused: "), F.col("reject_reason"))
    return fail_where(rows, text).drop("reject_reason")


def to_messages(rows):
    """Each row as (key = order_id bytes, value = JSON bytes of all fields)."""
    value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(
        F.col("order_id").cast("binary").alias("key"), value.cast("binary").alias("value")
    )


def write_messages(rows, servers, topic):
    """Publish the rows to a topic; needs the Kafka connector on the class path."""
    (
        to_messages(rows)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def ingest_csv_once(spark, folder, bronze_path, checkpoint, with_source=False):
    """Append every CSV file not taken before; a second call on the same files adds none.

    Each row is stored with the file it came from, which `with_source` shows.
    """
    rows = use_utc(spark).readStream.schema(BRONZE).options(**TYPED).csv(folder)
    query = (
        rows.select("*", F.col("_metadata.file_path").alias("source_file"))
        .writeStream.format("parquet")
        .option("path", bronze_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    stored = T.StructType([*BRONZE.fields, T.StructField("source_file", T.StringType())])
    return spark.read.schema(stored if with_source else BRONZE).parquet(bronze_path)


def _exported(field):
    column = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.when(column, "t").when(~column, "f")
    if isinstance(field.dataType, T.TimestampType):
        fraction = F.regexp_replace(F.date_format(column, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit("+00"))
    return column


def export_snapshot(tables, folder):
    """Each (frame, key) of `tables` as CSV with header, sorted by key across its files.

    Booleans are t/f and instants carry +00, as the measures expect, with the fraction they have.
    """
    for name, (frame, key) in tables.items():
        shown = [_exported(f).alias(f.name) for f in frame.schema]
        (
            frame.repartitionByRange(key)
            .sortWithinPartitions(key)
            .select(*shown)
            .write.mode("overwrite")
            .options(**DIALECT, emptyValue='""')
            .csv(f"{folder}/{name}")
        )


def export_order(rows, key):
    """One row: how many rows an exported table has, and whether `key` never falls within and across its files.

    A scan gives the rows of each piece of a file in their order. Only the first and last key of a piece
    meet those of the next.
    """
    piece = ["_file", "_start"]
    placed = rows.select(
        key.alias("_key"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    before = F.lag("_key").over(Window.partitionBy(*piece).orderBy("_row"))
    pieces = (
        placed.withColumn("_falls", F.col("_key") < before)
        .groupBy(*piece)
        .agg(
            F.count("*").alias("rows"),
            F.count_if("_falls").alias("falls"),
            F.min_by("_key", "_row").alias("first"),
            F.max_by("_key", "_row").alias("last"),
        )
    )
    # One row for each piece of a file: the names of the files are in the order of their ranges.
    last = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy(*piece))
    return pieces.withColumn("_falls", F.col("first") < last).agg(
        F.sum("rows").alias("rows"), ((F.sum("falls") + F.count_if("_falls")) == 0).alias("in_order")
    )
