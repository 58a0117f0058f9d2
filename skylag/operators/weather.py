"""Hourly weather: filling from nearby airports and joining to flights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag import schemas
from skylag.functions.clock import to_timestamp, with_departure_hour


def nearby_map(spark: SparkSession, pairs: Sequence[tuple[str, str]] = tuple(fixed.NEARBY_AIRPORTS)) -> DataFrame:
    """Airports without weather and the airport to copy from."""
    return spark.createDataFrame(list(pairs), schemas.NEARBY)


def missing_hours(candidates: DataFrame, weather: DataFrame) -> DataFrame:
    """Candidate rows whose airport has no row at that time. Nothing is deduplicated."""
    existing = weather.select(F.col("airport_code").alias("__airport"), F.col("time").alias("__time"))
    same_hour = (F.col("airport_code") == F.col("__airport")) & F.col("time").eqNullSafe(F.col("__time"))
    return candidates.join(existing, same_hour, "left_anti")


def nearby_rows(weather: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source rows relabelled for each mapped airport, with their provenance."""
    copied = weather.join(mapping, F.col("airport_code") == F.col("source"))
    return copied.select(
        *[F.col("missing").alias(c) if c == "airport_code" else F.col(c) for c in weather.columns],
        F.concat(F.lit("from_"), F.col("source")).alias("data_source"),
    )


def fill_from_nearby(weather: DataFrame, mapping: DataFrame) -> DataFrame:
    """Weather plus the missing hours copied from the mapped airport.

    Copies are taken from the original rows only, so a mapping onto an airport
    that is itself filled does not cascade. `data_source` is null on originals.
    """
    copies = missing_hours(nearby_rows(weather, mapping), weather)
    return weather.unionByName(copies, allowMissingColumns=True)


def weather_by_hour(weather: DataFrame, measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES)) -> DataFrame:
    """Weather keyed the way flights are joined to it."""
    time = to_timestamp("time")
    return weather.select(
        F.col("airport_code").alias("Origin"),
        F.to_date(time).alias("date"),
        F.hour(time).alias("hour"),
        *measures,
    )


def join_weather(
    flights: DataFrame,
    weather: DataFrame,
    measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES),
    null_safe: bool = False,
    keep_keys: bool = False,
    copies: str | None = None,
) -> DataFrame:
    """Flights with the weather at their origin in the scheduled local departure hour.

    Left equi-join on (airport, date, hour). Several weather rows for one hour give
    several flight rows. The key has airport, date and hour, so a busy airport is
    spread over all its hours; runtime skew splitting handles what is left.
    `null_safe` also matches unknown keys to unknown keys.

    With `copies`, weather rows of one hour with equal measures give one flight row, and the
    column of that name counts them (1 without weather): flights times weather rows of an hour
    are then written out only as far as the measures differ.
    """
    hourly = weather_by_hour(weather, measures)
    if copies is not None:
        hourly = hourly.groupBy("Origin", "date", "hour", *measures).agg(F.count(F.lit(1)).alias(copies))
    hourly = hourly.withColumnRenamed("Origin", "__airport")
    keyed = with_departure_hour(flights)
    pairs = [("Origin", "__airport"), ("FlightDate", "date"), ("dep_hour", "hour")]
    condition = None
    for left, right in pairs:
        equal = F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right)
        condition = equal if condition is None else condition & equal
    joined = keyed.join(hourly, condition, "left").drop("__airport")
    if copies is not None:
        joined = joined.withColumn(copies, F.coalesce(F.col(copies), F.lit(1)).cast("bigint"))
    return joined if keep_keys else joined.drop("date", "hour")


def station_series(
    assignments: DataFrame,
    hourly: DataFrame,
    first_year: int,
    last_year: int,
) -> DataFrame:
    """Hourly rows of each airport's station between January 1 of the first and
    December 31, 23:00 of the last year, labelled with the airport.

    `assignments` has (airport_code, station_id); airports without a station and
    stations without rows drop out.
    """
    start = F.lit(f"{first_year}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{last_year}-12-31 23:00:00").cast("timestamp_ntz")
    within = hourly.filter(F.col("time").between(start, end))
    mapped = assignments.select("airport_code", "station_id").filter(F.col("station_id").isNotNull())
    return within.join(mapped, "station_id").drop("station_id")
