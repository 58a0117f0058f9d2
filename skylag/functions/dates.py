"""Date parts with the two weekday numberings kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylag.functions.clock import as_column


def weekday_sunday_first(date: Column | str) -> Column:
    """1=Sunday .. 7=Saturday."""
    return F.dayofweek(as_column(date))


def weekday_monday_first(date: Column | str) -> Column:
    """1=Monday .. 7=Sunday."""
    return F.weekday(as_column(date)) + 1


def weekday_name(date: Column | str) -> Column:
    return F.date_format(as_column(date), "EEEE")


def iso_date(date: Column | str) -> Column:
    return F.date_format(as_column(date), "yyyy-MM-dd")


def parse_date(text: Column | str) -> Column:
    """yyyy-MM-dd text to date, null where it does not parse."""
    return as_column(text).try_cast("date")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_column(later), as_column(earlier))


def nth_weekday(year: Column | str, month: int, day_name: str, n: int) -> Column:
    """Date of the n-th given weekday of a month, e.g. 4th 'THU' of November."""
    first = F.make_date(as_column(year), F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), day_name), 7 * (n - 1))


def last_weekday(year: Column | str, month: int, day_name: str) -> Column:
    """Date of the last given weekday of a month."""
    end = F.last_day(F.make_date(as_column(year), F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), day_name)


def date_range(first: Column, last: Column, step_days: int = 1) -> Column:
    """Array of the dates from first to last, both included."""
    return F.sequence(first, last, F.make_dt_interval(F.lit(step_days)))
