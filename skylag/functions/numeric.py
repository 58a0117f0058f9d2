"""Null-safe arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylag.functions.clock import as_column


def indicator(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def fill_null(value: Column | str, default: object) -> Column:
    return F.coalesce(as_column(value), F.lit(default))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)


def round_half_up(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for stable comparison of results."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
