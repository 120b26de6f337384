import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ordermill.operators.parse import message_text, parse_events
from ordermill.operators.silver import bronze_from_inbox
from ordermill.plans import gold
from ordermill.schemas import DEFAULT_TOPIC, INBOX
from ordermill.sources.messages import MessageFolder, json_stream
from ordermill.sources.store import read_or_empty
from ordermill.streaming import ingest, inspect, windows
from samples import START, bronze, event, message, messages, order, texts, values


class Topic:
    """A folder that receives one file of messages per call."""

    def __init__(self, spark, path):
        self.spark, self.path, self.offset = spark, path, 0
        self.source = MessageFolder(path, max_per_batch=1)
        os.makedirs(path)

    def send(self, *rows, offset=None):
        taken = []
        for row in rows:
            row = row if isinstance(row, tuple) else message(row, self.offset)
            self.offset = row[4] + 1
            taken.append(row)
        messages(self.spark, taken).coalesce(1).write.mode("append").parquet(self.path)


def table_state(spark, to):
    state = {name: texts(t) for name, t in gold.gold_tables(to.gold(spark)).items()}
    state["inbox"] = texts(
        read_or_empty(spark, to.inbox, INBOX).select("partition_id", "kafka_offset", "ingested_at")
    )
    return state


def run(spark, topic, to, folder, **options):
    lines = []
    query = ingest.start_ingest(
        spark, topic.source, to, folder("state"), "backfill", report=lines.append, **options
    )
    query.awaitTermination()
    return lines


@pytest.fixture
def to(folder):
    return ingest.Destination(folder("lake"), "retail-local", DEFAULT_TOPIC, "t1")


@pytest.mark.parametrize("incremental", [True, False])
def test_backfill_restart_and_replay(spark, folder, to, incremental):
    topic = Topic(spark, folder("topic"))
    topic.send(*order(1)[:2], *order(2))
    lines = run(spark, topic, to, folder, incremental=incremental)
    assert len(lines) == 1 and "read=6, inserted=6, already_present=0" in lines[0]
    before = table_state(spark, to)
    assert run(spark, topic, to, folder, incremental=incremental) == []
    assert table_state(spark, to) == before

    # The same messages once more, and the same events under new offsets.
    topic.send(*[message(r, i) for i, r in enumerate([*order(1)[:2], *order(2)])])
    topic.send(*[message(r, 50 + i) for i, r in enumerate(order(2))])
    # A late event and a new customer in another batch.
    topic.send(message(order(1)[2], 60), *[message(r, 61 + i) for i, r in enumerate(order(3, customer_id="A"))])
    lines = run(spark, topic, to, folder, incremental=incremental)
    assert [line.split(": ")[1] for line in lines] == [
        "read=6, inserted=0, already_present=6",
        "read=4, inserted=4, already_present=0",
        "read=5, inserted=5, already_present=0",
    ]
    inbox = read_or_empty(spark, to.inbox, INBOX)
    assert inbox.count() == 15
    report = gold.build_gold(to.gold(spark), ingest.silver_table(spark, to), bronze_from_inbox(inbox))
    assert not report.changed and report.source == {"events": 11, "bronze_rows": 15, "orders": 3}


@pytest.mark.parametrize("broken", ["append_silver", "refresh_gold"])
def test_failure_inside_a_batch(spark, folder, to, monkeypatch, broken):
    """The batch stops half way; the restart ends where an undisturbed run ends."""
    topic = Topic(spark, folder("topic"))
    topic.send(*order(1), *order(2))
    topic.send(*[message(r, 20 + i) for i, r in enumerate(order(3))])
    working = getattr(ingest, broken)
    calls = []

    def fail_second(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("simulated loss")
        return working(*args, **options)

    monkeypatch.setattr(ingest, broken, fail_second)
    with pytest.raises(Exception, match="simulated loss"):
        run(spark, topic, to, folder)
    assert read_or_empty(spark, to.inbox, INBOX).count() == 12
    lines = run(spark, topic, to, folder)
    assert ["read=4, inserted=0, already_present=4" in line for line in lines] == [True]
    inbox = read_or_empty(spark, to.inbox, INBOX)
    assert inbox.count() == 12
    report = gold.build_gold(to.gold(spark), ingest.silver_table(spark, to), bronze_from_inbox(inbox))
    assert not report.changed and report.source["events"] == 12


def test_conflicting_batch_is_refused(spark, folder, to):
    topic = Topic(spark, folder("topic"))
    topic.send(*order(1))
    run(spark, topic, to, folder)
    before = table_state(spark, to)
    topic.send(message(event("X", "ORD-0009"), 90), message(event("Y"), 0))
    with pytest.raises(Exception, match="a second, different message"):
        run(spark, topic, to, folder)
    assert table_state(spark, to) == before


def test_preview_stores_a_sample_without_checkpoint(spark, folder, to):
    topic = Topic(spark, folder("topic"))
    topic.send(*order(1), *order(2))
    assert ingest.run_preview(spark, topic.source, to, rows=8).inserted == 8
    assert not os.path.exists(folder("state"))
    lines = run(spark, topic, to, folder)
    assert "inserted=0, already_present=8" in lines[0]


def test_checkpoint_belongs_to_one_source(spark, folder, to):
    location = ingest.claim_progress(spark, folder("state"), to)
    assert ingest.claim_progress(spark, folder("state"), to) == location
    other = ingest.Destination(to.root, to.cluster, to.topic, "recreated")
    with pytest.raises(RuntimeError, match="keeps the progress of"):
        ingest.claim_progress(spark, folder("state"), other)
    with pytest.raises(ValueError, match="unknown mode"):
        ingest.start_ingest(spark, None, to, folder("state"), "other")


def test_inspection(spark, folder):
    topic = Topic(spark, folder("topic"))
    bad = [b"not JSON", None, b"[1]", b"{'event_id': 'E'}"]
    topic.send(
        *[message(event(f"E{i}"), i, partition=i % 2) for i in range(6)],
        *[message(event(), 10 + i, value=v) for i, v in enumerate(bad)],
    )
    seen = []
    inspect.start_inspection(
        spark, topic.source, folder("state"), lambda *a: seen.append(a), once=True
    ).awaitTermination()
    (_, summary, samples), = seen
    assert [tuple(r) for r in summary] == [(0, 7, 0, 13, 4), (1, 3, 1, 5, 0)]
    assert len(samples) == 5


def test_parsing_keeps_every_message(spark):
    given = [message(event("E1"), 0), message(event(), 1, value=b"oops"), message(event(), 2, value=None)]
    parsed = parse_events(message_text(messages(spark, given))).orderBy("offset").collect()
    assert [r.json_parse_error for r in parsed] == [False, True, True]
    assert parsed[0].event_id == "E1" and parsed[1].event_json == "oops"
    assert parsed[1]._corrupt_record == "oops" and parsed[2].order_key == "ORD-0001"


# Minutes after ten o'clock in the order of arrival, and the windows that close.
ARRIVALS = (1, 20, 14, 2, 40)
CLOSED = {("10:00", 1), ("10:10", 1), ("10:20", 1)}


def test_watermark_drops_what_comes_too_late(spark, folder):
    def arrive(minute):
        moment = F.make_timestamp(F.lit(2026), F.lit(9), F.lit(14), F.lit(10), F.lit(minute), F.lit(0))
        spark.range(1).select(moment.alias("event_time")).write.mode("append").json(folder("in"))

    arrive(ARRIVALS[0])
    stream = json_stream(spark, folder("in"), "event_time timestamp")
    counts = windows.window_counts(stream, "event_time")
    query = windows.start_memory_sink(counts, "late_windows", folder("state"))
    query.processAllAvailable()
    for minute in ARRIVALS[1:]:
        arrive(minute)
        query.processAllAvailable()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    query.stop()
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert values(spark.table("late_windows").select(F.date_format("start", "HH:mm"), "count")) == CLOSED


def test_windows_by_type_on_a_table(spark):
    rows = [
        event("A"),
        event("B", is_late_event=True),
        event("C", "O2", "ORDER_SHIPPED"),
        event("D", event_time_utc=START + timedelta(minutes=10)),
    ]
    found = windows.event_type_windows(bronze(spark, rows))
    shown = found.select(F.date_format("start", "HH:mm"), "event_type", "events", "late_events")
    assert values(shown) == {
        ("15:15", "ORDER_CREATED", 2, 1),
        ("15:15", "ORDER_SHIPPED", 1, 0),
        ("15:25", "ORDER_CREATED", 1, 0),
    }


def test_stream_repeats_are_dropped(spark, folder):
    rows = [event("A"), event("B", hours=0.05), event("A")]
    for i, row in enumerate([*rows, event("A"), event("C", hours=0.1)]):
        bronze(spark, [row]).coalesce(1).write.mode("append").parquet(folder("in"))
    stream = spark.readStream.schema(bronze(spark, []).schema).parquet(folder("in"))
    query = windows.start_memory_sink(windows.distinct_events(stream), "distinct_events", folder("state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.event_id for r in spark.table("distinct_events").collect()) == ["A", "B", "C"]
