"""Clock numbers (HHMM), coercions and minute timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value: Column | str) -> Column:
    """Double, or null where the text is not a number (ANSI mode would raise)."""
    return as_column(value).try_cast("double")


def to_timestamp(value: Column | str, fmt: str | None = None) -> Column:
    """Zone-less timestamp, or null where the text does not parse."""
    column = as_column(value)
    if fmt is None:
        return column.try_cast("timestamp_ntz")
    return F.try_to_timestamp(column.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def clock_hour(hhmm: Column | str) -> Column:
    """930 -> 9. 2400 stays hour 24, which no hourly series contains."""
    return F.floor(to_number(hhmm) / 100).cast("int")


def clock_minutes(hhmm: Column | str) -> Column:
    """930 -> 570 minutes after midnight."""
    number = to_number(hhmm)
    return (F.floor(number / 100) * 60 + number % 100).cast("int")


def epoch_minutes(date: Column | str, hhmm: Column | str) -> Column:
    """Whole minutes since 1970-01-01 of a local date and clock number."""
    days = F.unix_date(as_column(date).cast("date")).cast("bigint")
    return days * MINUTES_PER_DAY + clock_minutes(hhmm)


def with_departure_hour(flights: DataFrame) -> DataFrame:
    """Adds dep_hour unless it is there; joins on the same column can share a shuffle."""
    return flights if "dep_hour" in flights.columns else flights.withColumn("dep_hour", clock_hour("CRSDepTime"))
