"""Number functions with the rounding and fallbacks that report figures use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards positive infinity, on the binary double."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def share6(x: Column) -> Column:
    """A ratio at six decimals."""
    return half_up(x, 6)


def sanitize(x: Column) -> Column:
    """Finite and positive, or 0."""
    x = x.cast("double")
    return F.when((x > 0) & (x < float("inf")), x).otherwise(0.0)


def money_sum(x: Column) -> Column:
    """A sum of cents: exact, so that partitions may come in any order."""
    return F.coalesce(F.sum(x.cast("decimal(18,2)")), F.lit(0)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def to_wan(yuan: Column) -> Column:
    """Yuan in ten thousands, two decimals."""
    return half_up(yuan.cast("double") / 100) / 100


def percent_text(x: Column) -> Column:
    """One decimal and a percent sign; '-' for null."""
    value = half_up(x * 1000) / 10
    text = F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "-").otherwise(F.concat(text, F.lit("%")))


def amount_text(x: Column) -> Column:
    """Rounded, with a comma for every three digits."""
    return F.format_number(half_up(x), 0)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def parse_number(text: Column) -> Column:
    """First line, commas dropped, a dot before exactly three digits taken as a thousands mark; 0 where it is no number."""
    line = F.trim(F.regexp_replace(first_line(text), ",", ""))
    plain = F.regexp_replace(line, r"\.(\d{3})(?!\d)", "$1")
    return F.coalesce(F.regexp_extract(plain, r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double"), F.lit(0.0))
