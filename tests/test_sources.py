import csv
import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordermill.schemas import INBOX
from ordermill.sources import delimited, derived, inbox
from ordermill.sources.messages import MessageFolder, preview
from ordermill.sources.store import VersionedTables, read_or_empty
from samples import START, bronze, event, message, messages, values

HEADER = (
    "event_id,order_id,event_type,event_time_utc,producer_time_utc,customer_id,product_id,category,"
    "quantity,unit_price_vnd,order_total_vnd,payment_method,city,device,traffic_source,promo_code,"
    "is_late_event"
)
LINE = (
    "{},ORD-0001,ORDER_CREATED,2026-08-29 15:16:45,2026-08-29 15:17:45,C1,P1,Books,2,100.00,200.00,"
    'CARD,"Đà Nẵng, VN",MOBILE,ADS,{},false'
)


def write(tmp_path, name, *lines, bom=False):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


@pytest.mark.parametrize("bom", [False, True])
def test_typed_csv_keeps_duplicates(spark, tmp_path, bom):
    path = write(tmp_path, "a.csv", HEADER, LINE.format("E1", ""), LINE.format("E1", ""), bom=bom)
    rows = delimited.read_bronze_csv(spark, path).collect()
    assert len(rows) == 2
    assert rows[0].event_id == "E1" and rows[0].city == "Đà Nẵng, VN"
    assert str(rows[0].order_total_vnd) == "200.00" and rows[0].is_late_event is False


def test_typed_csv_tells_empty_from_missing(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER, LINE.format("E1", ""), LINE.format("E2", '""'))
    assert [r.promo_code for r in delimited.read_bronze_csv(spark, path).collect()] == [None, ""]


def test_typed_csv_refuses_bad_values(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER, LINE.format("E1", "").replace(",2,", ",two,"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        delimited.read_bronze_csv(spark, path).collect()


@pytest.mark.parametrize("bom", [False, True])
def test_scan_names_bad_rows(spark, tmp_path, bom):
    lines = ["event_id,order_id,note", "E1,O1,", "E2,O2", "E3,O3,x,y", " ,O4,x", "E5,,x"]
    rows = delimited.scan_csv(spark, write(tmp_path, "a.csv", *lines, bom=bom)).collect()
    reasons = [r.reject_reason for r in rows]
    assert reasons == [None, "wrong number of fields", "wrong number of fields", "blank event_id",
                       "blank order_id"]
    assert rows[0].note == ""


def test_strict_scan_fails_even_when_narrowed(spark, tmp_path):
    path = write(tmp_path, "a.csv", "event_id,order_id,note", "E1,O1,x", "E2,O2")
    with pytest.raises(PySparkException, match="CSV row refused"):
        delimited.strict_csv(spark, path).select("order_id").collect()
    good = write(tmp_path, "b.csv", "event_id,order_id,note", "E1,O1,")
    assert values(delimited.strict_csv(spark, good)) == {("E1", "O1", "")}


@pytest.mark.parametrize("header", ["event_id,note", "event_id,order_id,note,note"])
def test_header_rules(spark, tmp_path, header):
    with pytest.raises(ValueError, match="header"):
        delimited.strict_csv(spark, write(tmp_path, "a.csv", header, "1,2,3,4"))


def test_rows_become_messages(spark, tmp_path):
    path = write(tmp_path, "a.csv", "event_id,order_id,note", "E1,Ø1,", "E2,O2,é")
    found = delimited.to_messages(delimited.strict_csv(spark, path)).collect()
    assert {(bytes(r.key).decode(), bytes(r.value).decode()) for r in found} == {
        ("Ø1", '{"event_id":"E1","order_id":"Ø1","note":""}'),
        ("O2", '{"event_id":"E2","order_id":"O2","note":"é"}'),
    }


def test_files_are_ingested_once(spark, tmp_path, folder):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.csv", HEADER, LINE.format("E1", ""), LINE.format("E1", ""))
    args = (spark, folder("in"), folder("bronze"), folder("state"))
    assert delimited.ingest_csv_once(*args).count() == 2
    assert delimited.ingest_csv_once(*args).count() == 2
    write(tmp_path / "in", "b.csv", HEADER, LINE.format("E2", "X"))
    assert delimited.ingest_csv_once(*args).count() == 3


def test_export_keeps_fractions(spark, folder):
    times = [(1, "2026-08-29 15:16:45.123456"), (2, "2026-08-29 15:16:45.5"), (3, "2026-08-29 15:16:45"), (4, None)]
    frame = spark.createDataFrame(times, "k long, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    delimited.export_snapshot({"t": (frame, "k")}, folder("out"))
    lines = [x for p in sorted(glob.glob(folder("out/t/part-*.csv"))) for x in open(p, encoding="utf-8").read().splitlines()[1:]]
    assert lines == ["1,2026-08-29 15:16:45.123456+00", "2,2026-08-29 15:16:45.5+00", "3,2026-08-29 15:16:45+00", "4,"]


def test_export_format(spark, folder):
    rows = [event("E2", promo_code=""), event("E1", is_late_event=True, promo_code=None)]
    delimited.export_snapshot({"events": (bronze(spark, rows), "event_id")}, folder("out"))
    lines = []
    for path in sorted(glob.glob(folder("out/events/part-*.csv"))):
        lines += open(path, encoding="utf-8").read().splitlines()[1:]
    assert [line.split(",")[0] for line in lines] == ["E1", "E2"]
    assert "2026-08-29 15:16:45+00" in lines[0]
    assert lines[0].endswith(",ADS,,t") and lines[1].endswith(',ADS,"",f')


@pytest.mark.parametrize("value", ['say "hi", twice', " outer ", "a,b", "back\\slash", '"'])
def test_csv_values_survive(spark, folder, value):
    frame = bronze(spark, [event(city=value)])
    delimited.export_snapshot({"t": (frame.select("event_id", "order_id", "city"), "event_id")}, folder("o"))
    line = open(glob.glob(folder("o/t/part-*.csv"))[0], encoding="utf-8").read().splitlines()[1]
    assert next(csv.reader([line]))[2] == value
    assert delimited.strict_csv(spark, folder("o/t")).first().city == value


def test_inbox_scenario(spark, folder):
    path = folder("inbox")
    batch = [
        message(event("E0"), 0),
        message(event("E1"), 1),
        message(event("E2"), 2, value=b"not JSON\xff\x00"),
        message(event("E3"), 3, value=None),
        message(event("E0"), 0, partition=1),
    ]

    def store(rows, topic_id="t1"):
        rows = inbox.as_inbox_rows(messages(spark, rows), "cluster", topic_id)
        done = inbox.append_inbox(spark, rows, path, "retail-order-events")
        return done.read, done.inserted

    def snapshot():
        return sorted(map(str, read_or_empty(spark, path, INBOX).collect()))

    assert store(batch) == (5, 5)
    before = snapshot()
    assert store(batch) == (5, 0)
    assert snapshot() == before
    with pytest.raises(ValueError, match="a second, different message"):
        store([message(event("E4"), 4), message(event("E0"), 0, value=b"changed")])
    assert snapshot() == before
    with pytest.raises(ValueError, match="a topic other than"):
        store([message(event("E4"), 4, topic="other")])
    with pytest.raises(ValueError, match="a second, different message"):
        store([message(event("E4"), 4), message(event("E5"), 4)])
    assert snapshot() == before
    assert store([message(event("E0"), 0)], "recreated") == (1, 1)
    assert store([message(event("E9"), 9), message(event("E9"), 9)]) == (2, 1)
    assert store([]) == (0, 0)
    raw = read_or_empty(spark, path, INBOX).filter("kafka_offset = 2").first().raw_value
    assert bytes(raw) == b"not JSON\xff\x00"
    assert read_or_empty(spark, path, INBOX).filter("raw_value is null").count() == 1


def test_inbox_conflicts_and_new_rows(spark):
    rows = lambda *given: inbox.as_inbox_rows(messages(spark, list(given)), "c", "t")
    stored = rows(message(event("E0"), 0), message(event("E1"), 1))
    batch = rows(message(event("E0"), 0), message(event("X"), 1), message(event("E2"), 2))
    assert values(inbox.inbox_conflicts(batch, stored), "kafka_offset") == {(1,)}
    assert values(inbox.new_inbox_rows(batch, stored), "kafka_offset") == {(2,)}


def test_invalid_inbox_keys(spark):
    rows = [
        ("c", "t", "topic", 0, 0, None, None, 0, START),
        ("c", "t", "topic", 0, 0, None, None, 0, START),
        ("c", "t", "topic", -1, 0, None, None, 0, START),
        ("c", "t", "topic", 0, -5, None, None, 0, START),
        (None, "t", "topic", 0, 7, None, None, 0, START),
        ("c", "t", "topic", 0, 8, None, None, 0, START),
    ]
    found = inbox.invalid_inbox_keys(spark.createDataFrame(rows, INBOX))
    assert values(found, "problem", "kafka_offset") == {
        ("repeated coordinate", 0),
        ("negative partition", 0),
        ("negative offset", -5),
        ("missing key part", 7),
    }


def test_coverage_and_latest(spark):
    rows = inbox.as_inbox_rows(
        messages(spark, [message(event(f"E{i}"), i, partition=i % 2) for i in range(6)]), "c", "t"
    )
    cover = inbox.inbox_coverage(rows)
    assert values(cover, "partition_id", "rows", "first_offset", "last_offset") == {
        (0, 3, 0, 4),
        (1, 3, 1, 5),
    }
    aged = rows.withColumn("ingested_at", F.timestamp_seconds("kafka_offset"))
    newest = inbox.latest_messages(aged, 2).collect()
    assert [r.kafka_offset for r in newest] == [5, 4]
    assert newest[0].order_key == "ORD-0001"


def test_preview_is_bounded(spark, folder):
    messages(spark, [message(event(f"E{i}"), i) for i in range(9)]).write.parquet(folder("topic"))
    assert preview(spark, MessageFolder(folder("topic")), 4).count() == 4


def test_versions_change_together(spark, folder):
    store = VersionedTables(spark, folder("gold"))
    schema = "x int"
    assert store.read("a", schema).count() == 0
    store.stage("a", spark.createDataFrame([(1,)], schema))
    store.stage("b", spark.createDataFrame([(5,)], schema))
    assert store.current() == (0, {})
    assert store.publish(replaced=["a", "b"]) == 1
    store.stage("a", spark.createDataFrame([(2,)], schema))
    assert values(store.read("a", schema)) == {(1,)}
    assert store.publish(extended=["a"]) == 2
    assert values(store.read("a", schema)) == {(1,), (2,)}
    store.stage("a", spark.createDataFrame([(3,)], schema))
    assert store.publish(replaced=["a"]) == 3
    assert values(store.read("a", schema)) == {(3,)}
    assert values(store.read("b", schema)) == {(5,)}


def test_tasks_of_derived_rows_follow_the_orders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "ORDERS_PER_TASK", 25)
    spark.range(100).selectExpr("id o_orderkey", "id % 9 o_custkey", "timestamp'2020-01-01' o_orderdate").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).selectExpr("id p_partkey", "'T' p_type", "1.5D p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    rows = derived.raw_sales(spark, str(tmp_path), "k")
    assert rows.rdd.getNumPartitions() == 5
    assert rows.select("k").distinct().count() == 100
