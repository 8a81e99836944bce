"""Time of day and dates.  Seconds since midnight are the computed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import CLOCK_PREFIX, DATE_SUFFIX, SECONDS_PER_DAY
from .logic import as_column

_CLOCK = r"^\d{1,2}:\d{2}:\d{2}$"


def fraction_to_seconds(col: Column | str) -> Column:
    """Day fraction below 1 to whole seconds, halves to even; else null.

    Texts with a colon are not tried as numbers: a failed cast is costly.
    """
    text = as_column(col)
    day = F.when(~text.contains(":"), text.try_cast("double"))
    return F.when(day < 1, F.rint(day * SECONDS_PER_DAY).cast("bigint"))


def clock_to_seconds(col: Column | str, prefix: str = CLOCK_PREFIX) -> Column:
    """``[prefix]HH:MM:SS`` to seconds; null when the text is not a clock time."""
    text = F.replace(as_column(col), F.lit(prefix), F.lit(""))
    hours = F.substring_index(text, ":", 1).cast("bigint")
    minutes = F.substr(text, F.lit(-5), F.lit(2)).cast("bigint")
    seconds = F.substr(text, F.lit(-2)).cast("bigint")
    return F.when(text.rlike(_CLOCK), hours * 3600 + minutes * 60 + seconds)


def normalize_time(col: Column | str) -> Column:
    """Seconds since midnight from either written form, decided row by row."""
    return F.coalesce(fraction_to_seconds(col), clock_to_seconds(col))


def _two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), text)).otherwise(text)


def format_clock(seconds: Column | str) -> Column:
    """Seconds to ``HH:MM:SS``; negative spans get a leading minus sign."""
    s = as_column(seconds).cast("bigint")
    size = F.abs(s)
    hours = F.floor(size / 3600)
    return F.concat(
        F.when(s < 0, F.lit("-")).otherwise(F.lit("")), _two_digits(hours), F.lit(":"),
        _two_digits(F.floor(size / 60) % 60), F.lit(":"), _two_digits(size % 60))


def clean_date(col: Column | str) -> Column:
    """Drop the midnight suffix from a date text and parse it."""
    return F.to_date(F.replace(as_column(col), F.lit(DATE_SUFFIX), F.lit("")))


def date_text(col: Column | str) -> Column:
    return F.date_format(as_column(col), "MM/dd/yyyy")
