"""Time the registered queries and the two load paths; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every result is computed in
full and discarded. Times are those of one run each, after one warm-up query.
"""

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import functions as F

from ordermill import catalog
from ordermill.operators.silver import bronze_from_inbox, silver_from_bronze
from ordermill.plans.gold import build_gold
from ordermill.session import build_session
from ordermill.sources import derived
from ordermill.sources.inbox import append_inbox, as_inbox_rows
from ordermill.streaming.ingest import Destination, silver_table, take_batch


def timed(times, name, work):
    start = time.time()
    result = work()
    times[name] = round(time.time() - start, 3)
    print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    return result


def drain(frame):
    frame.write.format("noop").mode("overwrite").save()


def loads(spark, sf_dir, root, times):
    """The whole way from messages to Gold, then one late micro-batch on top of it."""
    messages = derived.messages(spark, sf_dir)
    last = messages.agg(F.max("offset")).first()[0]
    early = messages.filter(F.col("offset") <= last - 2000)
    to = Destination(root, "retail-local", "retail-order-events", derived.TOPIC_ID)

    rows = as_inbox_rows(early, to.cluster, to.topic_id)
    timed(times, "load_inbox", lambda: append_inbox(spark, rows, to.inbox, to.topic))
    bronze = bronze_from_inbox(spark.read.parquet(to.inbox))
    timed(times, "load_silver", lambda: silver_from_bronze(spark, bronze, to.silver))
    load = lambda: build_gold(to.gold(spark), silver_table(spark, to), bronze)
    timed(times, "load_gold", load)
    timed(times, "load_gold_unchanged", load)

    # The batch arrives as files, as a stream would hand it over.
    messages.filter(F.col("offset") > last - 2000).write.parquet(f"{root}/arriving")
    batch = spark.read.parquet(f"{root}/arriving")
    timed(times, "micro_batch", lambda: take_batch(batch, to, report=lambda text: None))
    timed(times, "micro_batch_replayed", lambda: take_batch(batch, to, report=lambda text: None))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = tempfile.mkdtemp(prefix="ordermill-bench-")  # local mode: one machine has it all
    spark = build_session(
        "ordermill-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": f"{root}/shared",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    drain(derived.raw_sales(spark, sf_dir))
    for name, query in catalog.QUERIES.items():
        timed(times, name, lambda: drain(query(spark, sf_dir)))
    try:
        loads(spark, sf_dir, root, times)
    finally:
        shutil.rmtree(root, ignore_errors=True)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
