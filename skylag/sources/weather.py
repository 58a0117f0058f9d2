"""Landed hourly weather files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from skylag import schemas
from skylag.operators.weather import station_series
from skylag.sources.flights import read_csv


def read_hourly_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Weather with an airport or station column under the explicit schema."""
    return schemas.conform(spark.read.parquet(*paths), schemas.WEATHER)


def read_hourly_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Hourly station files as CSV; text that does not parse becomes null."""
    return read_csv(spark, *paths, schema=schemas.HOURLY_WEATHER)


def land_station_weather(assignments: DataFrame, station_files: Sequence[DataFrame], first_year: int, last_year: int) -> DataFrame:
    """All station files as one airport-labelled series of whole years."""
    hourly = station_files[0]
    for other in station_files[1:]:
        hourly = hourly.unionByName(other, allowMissingColumns=True)
    return station_series(assignments, hourly, first_year, last_year)
