"""Week numberings, month arithmetic and exact day spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts)


def monday_week_number(ts: Column) -> Column:
    """Week of the calendar year, weeks starting on Monday, 0 before the first Monday."""
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def monday_week_label(year: Column, week: Column) -> Column:
    return F.format_string("%04d-W%02d", year, week)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def week_span_label(start: Column) -> Column:
    """``first-day/last-day`` of the Monday-to-Sunday week."""
    return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def month_index(ts: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_label(index: Column) -> Column:
    year = F.floor(index / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index - year * 12 + 1).cast("int"))


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return micros_between(later, earlier).cast("double") / F.lit(float(DAY_MICROS))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days rounded down; integer arithmetic, so no instant is off by one."""
    micros = micros_between(later, earlier)
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / F.lit(float(DAY_MICROS))).cast("int")
