"""Session settings and the shared folder used to cut lineage."""

from pyspark.sql import SparkSession


def build_session(app_name="ordermill", master=None, **settings):
    """A UTC session with adaptive execution; `settings` override any option."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k: str(v) for k, v in settings.items()}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark):
    """All event text is UTC, so the session must read and print UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


ROWS_PER_PARTITION = 500_000


def enough_partitions(spark, rows):
    """Scans and shuffles of a partition for each `ROWS_PER_PARTITION` rows or so, which a task can sort in its memory.

    Larger numbers that the session has stay, and adaptive execution still puts small shuffled partitions together.
    """
    wanted = rows // ROWS_PER_PARTITION + 1
    shuffles, scans = "spark.sql.shuffle.partitions", "spark.sql.files.minPartitionNum"
    # Read without a default of ours, a number that nobody has set is the one that Spark uses.
    now = {
        shuffles: spark.conf.get(shuffles),
        scans: spark.conf.get(scans, None) or spark.sparkContext.defaultParallelism,
    }
    for name, number in now.items():
        if int(number) < wanted:
            spark.conf.set(name, wanted)
    return spark


def shared_folder(spark):
    """The folder every executor can reach, as named by the cluster.

    Only when the session names none, as in local tests, it is a folder of the warehouse.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return named or context.getCheckpointDir()
