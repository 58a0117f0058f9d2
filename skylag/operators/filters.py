"""Row and column selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.functions.clock import as_column
from skylag.schemas import columns_named_like, missing_columns


def _flag(df: DataFrame, name: str) -> Column:
    """The 0/1 or boolean flag as a boolean."""
    return F.col(name).cast("boolean")


def active(df: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """Flights known not to be cancelled; a null flag is dropped."""
    return df.filter(~_flag(df, cancelled))


def completed(df: DataFrame, flags: Iterable[str] = ("Cancelled", "Diverted")) -> DataFrame:
    """Drop flights flagged 1; a null flag is kept, an absent flag column is ignored."""
    for name in flags:
        if name in df.columns:
            df = df.filter(~_flag(df, name).eqNullSafe(True))
    return df


def delayed(df: DataFrame, label: str = "DepDel15", cancelled: str = "Cancelled") -> DataFrame:
    """Active flights that left 15 or more minutes late."""
    return df.filter((F.col(label) == 1) & ~_flag(df, cancelled))


def keep_existing(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that do not."""
    wanted = list(columns)
    absent = missing_columns(df, wanted)
    return df.select(*[c for c in wanted if c not in set(absent)]), absent


def without_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns; names that are absent do not matter."""
    return df.drop(*columns)


def without_columns_named_like(df: DataFrame, keywords: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose name contains a keyword (exact case), but never those in `keep`."""
    kept = set(keep)
    return df.drop(*[c for c in columns_named_like(df.columns, keywords, ignore_case=False) if c not in kept])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def in_year(df: DataFrame, year: int, column: str = "Year") -> DataFrame:
    """One year of a table; on a table partitioned by year only that folder is read."""
    return df.filter(F.col(column) == year)


def in_year_of(df: DataFrame, year: int, time: str = "time") -> DataFrame:
    """One year of a time series, as a range on the time itself so that it can be pushed down."""
    start = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")
    return df.filter((F.col(time) >= start) & (F.col(time) < end))


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all the columns have a value."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Groups of a minimum size, applied after an aggregate."""
    return df.filter(F.col(column) >= minimum)


def in_date_range(df: DataFrame, first: str, last: str, column: str = "date") -> DataFrame:
    """Both ends included, given as yyyy-MM-dd."""
    return df.filter(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def member_of(value: Column | str, members: Iterable[object]) -> Column:
    return as_column(value).isin(list(members))


def lookup(df: DataFrame, column: str, value: object, columns: Iterable[str]) -> DataFrame:
    """Selected columns of the rows with one key."""
    return df.filter(F.col(column) == value).select(*columns)


def features_and_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """One frame with the features and the target as a double column named `label`."""
    features = [c for c in df.columns if c != target]
    return df.select(*features, F.col(target).cast("double").alias(label))


def top(df: DataFrame, n: int, by: str, ties: Iterable[str], descending: bool = True) -> DataFrame:
    """The first n rows by a measure; `ties` makes the order total."""
    first = F.desc(by) if descending else F.asc(by)
    return df.orderBy(first, *ties).limit(n)
