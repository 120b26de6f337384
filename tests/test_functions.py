from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordermill.functions import clock, digest, numbers, text
from ordermill.functions.rows import fail_where


def one(spark, column, **given):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, silver, gold",
    [("", None, None), ("  ", None, None), ("null", "null", None), (" SALE ", "SALE", "SALE"),
     ("\t", "\t", "\t"), ("NULL", "NULL", "NULL")],
)
def test_promo_forms(spark, raw, silver, gold):
    assert one(spark, text.blank_to_null(F.col("x")), x=raw) == silver
    assert one(spark, text.blank_or_null_word_to_null(F.col("x")), x=raw) == gold


@pytest.mark.parametrize(
    "raw, bad",
    [("A", False), ("", True), (" ", True), ("Null", True), (" A", True), ("nullable", False)],
)
def test_unusable_ids(spark, raw, bad):
    assert one(spark, text.is_unusable_id(F.col("x")), x=raw) is bad


def test_null_id_is_unusable(spark):
    frame = spark.createDataFrame([(None, "a"), ("b", "a")], "x string, y string")
    found = frame.select(text.any_unusable_id(["x", "y"]).alias("v")).collect()
    assert [r.v for r in found] == [True, False]


@pytest.mark.parametrize(
    "raw, value", [("t", True), ("ON", True), (" yes ", True), ("tr", True), ("0", False), ("of", False)]
)
def test_boolean_spellings(spark, raw, value):
    assert one(spark, text.text_to_boolean(F.col("x")), x=raw) is value


def test_boolean_refuses_other_words(spark):
    assert one(spark, text.text_to_boolean(F.col("x"), strict=False), x="maybe") is None
    with pytest.raises(PySparkException, match="not a boolean"):
        one(spark, text.text_to_boolean(F.col("x")), x="maybe")


def test_utf8(spark):
    frame = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "x binary")
    assert [r.v for r in frame.select(text.utf8_text(F.col("x"), False).alias("v")).collect()] == ["ok", None]
    with pytest.raises(PySparkException):
        frame.select(text.utf8_text(F.col("x"))).collect()


def test_iso_offset_is_honoured(spark):
    shown = F.date_format(clock.iso_timestamp(F.col("x")), "yyyy-MM-dd HH:mm")
    assert one(spark, shown, x="2026-08-29T22:16:45+07:00") == "2026-08-29 15:16"
    assert one(spark, shown, x="2026-08-29 22:16:45") == "2026-08-29 22:16"


@pytest.mark.parametrize("word", ["now", "infinity", "today", "", "12:30", "2026", "2026-08"])
def test_words_are_no_times(spark, word):
    assert one(spark, clock.iso_timestamp(F.col("x"), strict=False), x=word) is None
    with pytest.raises(PySparkException):
        one(spark, clock.iso_timestamp(F.col("x")), x=word)


def test_split_and_rebuild(spark):
    stamp = F.col("x").cast("timestamp")
    given = "2026-08-29 15:16:45.123456"
    assert one(spark, clock.text_date(stamp), x=given) == "20262908"
    assert one(spark, clock.text_time(stamp), x=given) == "15:16:45.123456"
    back = clock.rebuild_timestamp(clock.text_date(stamp), clock.text_time(stamp))
    assert one(spark, back.cast("string"), x=given) == given
    plain = clock.rebuild_timestamp(F.lit("20262908"), F.lit("12:00:00"))
    assert one(spark, plain.cast("string"), x="") == "2026-08-29 12:00:00"


@pytest.mark.parametrize("bad", ["20263102", "20260013", "2026x908", "20260000"])
def test_impossible_dates(spark, bad):
    built = clock.rebuild_timestamp(F.col("x"), F.lit("10:00:00"), strict=False)
    assert one(spark, built, x=bad) is None
    with pytest.raises(PySparkException):
        one(spark, clock.rebuild_timestamp(F.col("x"), F.lit("10:00:00")), x=bad)


def test_date_parts(spark):
    day = F.lit(date(2026, 8, 29))
    assert one(spark, clock.date_key(day), x=0) == 20260829
    assert one(spark, clock.iso_weekday(day), x=0) == 6
    missing = F.lit(None).cast("timestamp")
    assert one(spark, clock.date_key(missing), x=0) is None


@pytest.mark.parametrize(
    "start, end, crossed",
    [("00:00:50", "00:01:10", 1), ("00:00:00", "00:00:59", 0), ("23:59:59", "23:59:00", 0),
     ("10:00:30", "09:59:59", -1), ("10:00:00", "10:45:00", 45)],
)
def test_minute_boundaries(spark, start, end, crossed):
    a, b = (F.lit(f"2026-01-01 {t}").cast("timestamp") for t in (start, end))
    assert one(spark, clock.minute_boundaries(a, b), x=0) == crossed


@pytest.mark.parametrize("day, week", [(1, "Week 1"), (7, "Week 1"), (8, "Week 2"), (31, "Week 5")])
def test_week_of_month(spark, day, week):
    assert one(spark, clock.week_of_month(F.col("x")), x=day) == week


def test_year_quarter(spark):
    assert one(spark, clock.year_quarter(F.lit(2026), F.lit(3)), x=0) == "2026 Q3"


@pytest.mark.parametrize("a, b, expected", [(1, 4, 0.25), (1, 0, 0.0), (None, 4, 0.0), (4, None, 0.0)])
def test_ratio(spark, a, b, expected):
    columns = [F.lit(v).cast("int") for v in (a, b)]
    assert one(spark, numbers.ratio(*columns), x=0) == expected


def test_failing_check_survives_pruning(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    checked = fail_where(frame, F.when(F.col("x") == 2, F.lit("two is bad")))
    with pytest.raises(PySparkException, match="two is bad"):
        checked.select("y").count()
    assert fail_where(frame, F.when(F.col("x") == 3, F.lit("no"))).count() == 2


def test_digest_tells_rows_apart_and_reads_no_hex_digits(spark):
    rows = [("a", None, 1), (None, "a", 1), ("a", "", 1), ("a1:b", "c", 1), ("a", "1:bc", 1), ("a", None, -1), ("~", None, None)]
    frame = spark.createDataFrame(rows * 2, "x string, y string, n int")
    found = digest.with_digest(frame, ["x", "y", "n"])
    assert found.select(*digest.DIGEST).distinct().count() == len(rows)
    assert digest.with_digest(frame.selectExpr("encode(x, 'UTF-8') x", "y", "n"), ["x", "y", "n"]).select(*digest.DIGEST).distinct().count() == len(rows)
    assert "conv(" not in found._jdf.queryExecution().optimizedPlan().toString()
