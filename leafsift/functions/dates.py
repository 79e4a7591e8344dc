"""Date text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TEXT = "yyyy-MM-dd HH:mm:ss"


def parse_asctime(text: Column) -> Column:
    """``Mon May  6 20:07:54 2019`` as a timestamp, null if malformed."""
    no_weekday = F.regexp_replace(text, r"^\s*\w+\s+", "")
    return F.try_to_timestamp(F.regexp_replace(no_weekday, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy"))


def asctime(at: Column) -> Column:
    """A timestamp as C-style date text; the day is padded with a blank."""
    weekday = F.element_at(
        F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(at) + 1
    )
    day = F.lpad(F.dayofmonth(at).cast("string"), 2, " ")
    return F.concat_ws(" ", weekday, F.date_format(at, "MMM"), day, F.date_format(at, "HH:mm:ss yyyy"))


def date_text(at: Column) -> Column:
    return F.date_format(at, DATE_TEXT)


def asctime_to_date_text(text: Column) -> Column:
    return date_text(parse_asctime(text))


def parse_date_text(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DATE_TEXT))
