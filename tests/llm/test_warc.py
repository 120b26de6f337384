"""WARC archives: round trip, revisits, pushed predicates, and archives of other writers."""

import gzip
import hashlib

from pyspark.sql import functions as F

from ordermill.llm import warc


def test_round_trip(spark, folder):
    big, other = "<p>é</p>" * 400, "x" * 1500
    rows = [(1, "http://a/", big), (2, "http://b/", big), (5, None, big), (3, "u\r\nv", "short"), (4, "w", "short"), (None, "n", big),
            (6, "e", None), (7, "f", ""), (8, "g", other), (8, "g", other), (9, "h", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"DIGEST": F.lit(1), "revisit": F.lit(2)})
    at = warc.write_archives(pages.repartition(3), folder("w"))
    got = warc.read_archives(spark, at).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or "", r["record_type"], r["refers_to"] or "") for r in got)
    assert kinds == [("", "revisit", "5"), ("1", "revisit", "5"), ("2", "revisit", "5"), ("3", "response", ""), ("4", "response", ""),
                     ("5", "response", ""), ("6", "response", ""), ("7", "response", ""), ("8", "response", ""), ("8", "revisit", "8"), ("9", "response", "")]
    html = {r[0]: (r[2] or "").encode() for r in rows}
    ids = {r["record_id"]: r["page_id"] for r in got}
    assert len(ids) == len(got)
    for r in got:
        full = html[int(r["page_id"])] if r["page_id"] else big.encode()
        assert r["payload_digest"] == hashlib.sha1(full).hexdigest() and r["http_length"] == len(full)
        assert r["payload"] == (bytearray(full) if r["record_type"] == "response" else None)
        if r["record_type"] == "revisit":
            assert ids[r["headers"]["warc-refers-to"]] == r["refers_to"]
    assert {r["target_uri"] for r in got if r["page_id"] == "3"} == {"u%0D%0Av"}


def test_predicates_reach_the_source(spark, folder):
    rows = [(k, f"http://{'ab'[k % 2]}/{k}", f"{k}" * 600) for k in range(100, 140)]
    at = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder("w"))
    read = warc.read_archives(spark, at)
    some = read.where(F.col("target_uri").startswith("http://a/") & (F.col("record_type") == "response") & F.col("page_id").isin("100", "101", "102"))
    assert sorted(r["page_id"] for r in some.collect()) == ["100", "102"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and " IN " not in plan
    assert read.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(spark, at, payload=False).where("payload IS NOT NULL").count() == 0


def test_ranges_cover_an_archive_once(spark, folder, monkeypatch):
    rows = [(k, "u", f"{k}-" * 700) for k in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    at = warc.write_archives(frame, folder("w"))
    reader = warc.WarcReader({"path": at})
    whole = reader.partitions()
    assert len(whole) == 1
    data = open(whole[0].path, "rb").read()
    cut = int.from_bytes(data[16:20], "little")  # the size of the first member, from its header
    parts = [warc.Range(whole[0].path, 0, cut), warc.Range(whole[0].path, cut, len(data))]
    ids = [[x for b in reader.read(p) for x in b.column("page_id").to_pylist()] for p in parts]
    assert len(ids[0]) == 1 and sorted(map(int, ids[0] + ids[1])) == list(range(60))


def test_archives_of_other_writers(spark, tmp_path):
    one = warc.record("response", 1, "u", b"a" * 200_000, hashlib.sha1(b"a" * 200_000).hexdigest(), 200_000, None, "<x:1>")
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "zipped.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["record_type"], len(r["payload"])) for r in got) == [("metadata", 5)] * 2 + [("response", 200_000)] * 2
    assert warc.read_archives(spark, str(tmp_path)).where("record_type = 'metadata'").count() == 2


def test_empty_table(spark, folder):
    at = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder("w"))
    assert warc.read_archives(spark, at).collect() == []
