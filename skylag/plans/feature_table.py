"""From clean flights and weather to the training table.

The calendar and the daily history are small tables written when these functions are
called; everything about single flights stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.clock import with_departure_hour
from skylag.models import prep
from skylag.operators.calendar import add_calendar_features
from skylag.operators.history import add_congestion, add_history
from skylag.operators.holidays import date_dimension, join_calendar, years_of
from skylag.operators.propagation import add_recent_arrival_features
from skylag.operators.weather import fill_from_nearby, join_weather


def flights_with_weather(
    flights: DataFrame, weather: DataFrame, mapping: DataFrame, measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES), copies: str | None = None
) -> DataFrame:
    """Flights joined to weather whose gaps are filled from nearby airports; `copies` as for join_weather."""
    return join_weather(flights, fill_from_nearby(weather, mapping), measures, copies=copies)


def propagation_table(
    flights: DataFrame, weather: DataFrame, mapping: DataFrame, measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES), copies: str | None = None
) -> DataFrame:
    """Flights with weather and the recent arrivals at their origin; with `copies` one row stands for so many equal ones."""
    return add_recent_arrival_features(flights_with_weather(flights, weather, mapping, measures, copies), copies=copies)


def known_only(weather: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Weather with 1 for every known value of the measures, for counts that do not need the values."""
    return weather.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(1.0)) for c in measures})


def measures_in(flights: DataFrame, weather: DataFrame, mapping: DataFrame, measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES)) -> list[str]:
    """The measures that any of these flights has a value of, found on the different hours of their origins."""
    hours = with_departure_hour(flights).select("Origin", "FlightDate", "CRSDepTime", "dep_hour").dropDuplicates(["Origin", "FlightDate", "dep_hour"])
    return prep.with_known_values(flights_with_weather(hours, weather, mapping, measures), measures)


def strategic_features(
    flights: DataFrame,
    weather: DataFrame,
    mapping: DataFrame,
    calendar_columns: Sequence[str] = ("days_to_next_holiday", "days_from_prev_holiday", "is_holiday_week_before"),
    measures: Sequence[str] = tuple(fixed.WEATHER_MEASURES),
    copies: str | None = None,
) -> DataFrame:
    """Only what is known a day ahead: calendar, holiday distance, scheduled traffic,
    rolling history and weather.

    The flights are shuffled twice at most: on the history key, and on (Origin,
    FlightDate, dep_hour), which the congestion and the weather join share. `copies` as
    for join_weather: one row for all equal ones, with their number.
    """
    dimension = date_dimension(years_of(flights))
    enriched = join_calendar(add_calendar_features(flights), dimension, list(calendar_columns))
    return join_weather(add_congestion(add_history(enriched)), fill_from_nearby(weather, mapping), measures, copies=copies)
