"""Date functions over report dates, which are kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOSE = r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})"


def parse_loose(text: Column) -> Column:
    """The first y.m.d, y-m-d or y/m/d in a text; months and days beyond their range roll over."""
    year, month, day = (F.regexp_extract(text, LOOSE, k).try_cast("int") for k in (1, 2, 3))
    start = F.make_date(F.when(year > 0, year), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, month - 1), day - 1)


def reference_date(report_time: Column, now: Column) -> Column:
    return F.coalesce(parse_loose(report_time), now)


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month; a day that the month lacks runs over into the next."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def age_at(birth: Column, day: Column) -> Column:
    """Full years from a birth date's text to a day; null outside 0 to 120."""
    born = parse_loose(birth)
    early = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    age = F.year(day) - F.year(born) - early.cast("int")
    return F.when((age >= 0) & (age <= 120), age)


def chinese_date(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
