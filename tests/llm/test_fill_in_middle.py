"""Fill-in-the-middle: piece tables, round trips, forms and defined results."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ordermill.llm import fill_in_middle as fim, queries

SF = "/root/testdata/sf0.001"
texts = st.text(alphabet="aé漢🙂<PSM>\n", max_size=30).filter(lambda t: not any(s in t for s in fim.SENTINELS))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(doc_id, text):
    text = text or ""
    digits = sha(f"1:{'null' if doc_id is None else doc_id}")
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, sha(text), sha(text))
    if h[3] % 100 < 20:
        return (n, "spm", a, b - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text))
    return (n, "psm", a, b - a, sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text))


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(0, 30), st.integers(0, 30), st.sampled_from([fim.PSM, fim.SPM]))
def test_the_inverse_arrangement_gives_the_text_back(text, a, b, form):
    data = text.encode()
    places = sorted((min(a, len(data)), min(b, len(data))))
    table = fim.PieceTable((memoryview(data), fim._MARKS), [(fim.TEXT, 0, len(data))])
    parts = table.cut(places)
    assert [p.bytes() for p in parts] == [data[: places[0]], data[places[0] : places[1]], data[places[1] :]]
    output = fim.arrange(parts, form)
    assert len(output.pieces) <= 6 and output.sha256() == hashlib.sha256(output.bytes()).hexdigest()
    assert fim.restore_pieces(output.bytes(), form).bytes() == data


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=6), st.lists(st.integers(0, 30), max_size=4))
def test_cuts_across_descriptors(chunks, places):
    whole = b"".join(chunks)
    places = sorted(min(p, len(whole)) for p in places)
    table = fim.PieceTable(chunks, [(k, 0, len(c)) for k, c in enumerate(chunks)])
    ends = [0, *places, len(whole)]
    assert [p.bytes() for p in table.cut(places)] == [whole[a:b] for a, b in zip(ends, ends[1:])]


def test_whole_table(spark):
    given_rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_fill_in_middle"](spark, SF).collect()}
    assert found == {r["doc_id"]: wanted(r["doc_id"], r["text"]) for r in given_rows}
    assert {f[1] for f in found.values()} == {"plain", "psm", "spm"}


def test_defined_results(spark):
    long = "é漢🙂x" * 1_000_000
    rows = [(k, t) for k, t in enumerate([None, "", "a", "<P>", "x<S>y", "<M", "<", long, "🙂" * 9, "<P" * 5])]
    rows += [(None, "no id"), (None, None), (3, "again"), (3, "again")] + [(100 + k, f"text {k} é<") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = frame.withColumns({x: F.lit(1) for x in ("row", "n", "FORM", "output", "h", "made")})
    found = fim.fill_in_middle(clashing).withColumn("back", fim.restored_text())
    got = found.select("row.doc_id", "row.text", "row.h", "n", "form", "first_cut", "last_cut", "output_sha256", fim.restored_sha256(), "back").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(k), t or "") for k, t in rows)
    for r in got:
        n, form, a, b, output, restored = wanted(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["output_sha256"], r[8], r["back"]) == (n, form, output, restored, r["text"] or "")
        assert form == "plain" or (r["first_cut"], r["last_cut"]) == (a, a + b)
    assert fim.fill_in_middle(frame.limit(0)).withColumn("back", fim.restored_text()).collect() == []


@pytest.mark.parametrize("percent, forms", [((100, 0), {"plain"}), ((0, 0), {"psm"}), ((0, 100), {"spm"})])
def test_shares_are_parameters(spark, percent, forms):
    frame = spark.createDataFrame([(k, "some text") for k in range(50)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(frame, plain_percent=percent[0], spm_percent=percent[1]).collect()} == forms
