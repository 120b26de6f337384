"""Time conversion; everything assumes the session reads timestamps as UTC."""

from pyspark.sql import functions as F

from ordermill.schemas import TEXT_DATE, TEXT_TIME

_TEXT_STAMP = f"{TEXT_DATE} HH:mm:ss[.SSSSSS]"


def iso_timestamp(text, strict=True):
    """ISO text, with or without an offset, as an instant.

    It needs a whole date: words such as `now`, a time alone and a year or month alone are no
    event times; they are refused.
    """
    dated = text.rlike("^ *[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}([ T]|$)")
    if not strict:
        return F.when(dated, text.try_cast("timestamp"))
    return F.when(dated, text.cast("timestamp")).when(
        text.isNotNull(),
        F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("timestamp"),
    )


def text_date(stamp):
    return F.date_format(stamp, TEXT_DATE)


def text_time(stamp):
    return F.date_format(stamp, TEXT_TIME)


def rebuild_timestamp(date_text, time_text, strict=True):
    """Inverse of `text_date` and `text_time`; impossible dates raise or give NULL."""
    joined = F.concat(date_text, F.lit(" "), time_text)
    convert = F.to_timestamp if strict else F.try_to_timestamp
    return convert(joined, F.lit(_TEXT_STAMP) if not strict else _TEXT_STAMP)


def is_text_date(text):
    """Eight digits; NULL counts as no date."""
    return F.coalesce(text.rlike("^[0-9]{8}$"), F.lit(False))


def date_key(stamp):
    """YYYYMMDD as an integer."""
    return (F.year(stamp) * 10000 + F.month(stamp) * 100 + F.dayofmonth(stamp)).cast("int")


def iso_weekday(day):
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(day) + 1).cast("short")


def minute_boundaries(start, end):
    """Minute marks crossed between two instants, not elapsed minutes."""
    whole = lambda stamp: F.floor(F.unix_seconds(stamp) / 60)
    return (whole(end) - whole(start)).cast("long")


def week_of_month(day_of_month):
    week = F.floor((day_of_month - 1) / 7) + 1
    return F.concat(F.lit("Week "), week.cast("string"))


def year_quarter(year, quarter):
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))
