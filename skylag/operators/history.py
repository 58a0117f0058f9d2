"""Schedule and history features that are known a day ahead."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylag.functions.clock import clock_hour, with_departure_hour
from skylag.functions.numeric import ratio
from skylag.session import materialized
from skylag.sources.sinks import replace_years

# History keys: name of the feature group and the columns that form its key.
HISTORY_KEYS = {
    "origin": ("Origin",),
    "airline": ("Marketing_Airline_Network",),
    "route": ("Origin", "Dest"),
}


def scheduled_traffic(flights: DataFrame) -> DataFrame:
    """Scheduled departures and arrivals per airport, date and hour, cancelled flights included."""
    departure = F.struct(
        F.col("Origin").alias("airport"), clock_hour("CRSDepTime").alias("hour"), F.lit(1).alias("d"), F.lit(0).alias("a")
    )
    arrival = F.struct(
        F.col("Dest").alias("airport"), clock_hour("CRSArrTime").alias("hour"), F.lit(0).alias("d"), F.lit(1).alias("a")
    )
    return (
        flights.select(F.col("FlightDate").alias("date"), F.inline(F.array(departure, arrival)))
        .groupBy("airport", "date", "hour")
        .agg(F.sum("d").alias("sched_departures"), F.sum("a").alias("sched_arrivals"))
    )


def add_congestion(flights: DataFrame) -> DataFrame:
    """Scheduled departures and arrivals at the origin in the flight's departure hour."""
    traffic = scheduled_traffic(flights).select(
        F.col("airport").alias("__airport"),
        F.col("date").alias("__date"),
        F.col("hour").alias("__hour"),
        F.col("sched_departures").alias("origin_sched_departures"),
        F.col("sched_arrivals").alias("origin_sched_arrivals"),
    )
    same_hour = (
        (F.col("Origin") == F.col("__airport"))
        & (F.col("FlightDate") == F.col("__date"))
        & (F.col("dep_hour") == F.col("__hour"))
    )
    return with_departure_hour(flights).join(traffic, same_hour, "left").drop("__airport", "__date", "__hour")


def rolling_rates(daily: DataFrame, keys: Sequence[str], prefix: str, spans: Sequence[int], date: str = "FlightDate") -> DataFrame:
    """Delay rate of a key over the `span` days before each day, that day excluded.

    `daily` has flights and late flights per (at least) key and day. One row per key
    and day enters the window, however many flights the key has.
    """
    per_day = daily.groupBy(*keys, date).agg(F.sum("__flights").alias("__flights"), F.sum("__late").alias("__late"))
    days = Window.partitionBy(*keys).orderBy(F.unix_date(date))
    columns = {}
    for span in spans:
        frame = days.rangeBetween(-span, -1)
        columns[f"{prefix}_delay_rate_{span}d"] = ratio(F.sum("__late").over(frame), F.sum("__flights").over(frame))
    return per_day.withColumns(columns).drop("__flights", "__late")


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = None
    for k in keys:
        a, b = F.col(k), F.col(f"__{k}")
        equal = a.eqNullSafe(b) if null_safe else a == b
        condition = equal if condition is None else condition & equal
    return left.join(other, condition, "left").drop(*[f"__{k}" for k in keys])


def daily_sums(flights: DataFrame, keys: Mapping[str, Sequence[str]] = HISTORY_KEYS, label: str = "DepDel15", cancelled: str = "Cancelled", date: str = "FlightDate") -> DataFrame:
    """Flown and late flights per day and value of all keys; flights without a date have no history."""
    grain = list(dict.fromkeys([c for k in keys.values() for c in k]))
    flown = ~F.col(cancelled).cast("boolean")
    return flights.filter(F.col(date).isNotNull()).groupBy(*grain, date).agg(
        F.count_if(flown).alias("__flights"),
        F.coalesce(F.sum(F.when(flown, F.col(label).cast("double"))), F.lit(0.0)).alias("__late"),
    )


def _features(daily: DataFrame, keys: Mapping[str, Sequence[str]], spans: Sequence[int], date: str) -> DataFrame:
    grain = list(dict.fromkeys([c for k in keys.values() for c in k]))
    features = daily.select(*grain, date)
    for prefix, columns in keys.items():
        rates = rolling_rates(daily, columns, prefix, spans, date)
        features = _join_on(features, rates, [*columns, date], null_safe=False)
    return features


def add_history(
    flights: DataFrame,
    keys: Mapping[str, Sequence[str]] = HISTORY_KEYS,
    spans: Sequence[int] = (7, 30),
    label: str = "DepDel15",
    cancelled: str = "Cancelled",
    date: str = "FlightDate",
) -> DataFrame:
    """Flights with rolling delay rates per origin, airline and route.

    Frames end the day before the flight, so nothing of its own day is seen. A key
    that is not known has no history; the flight keeps that of its other keys.

    The flights are summed once to a daily table, which is written to the shared
    folder and feeds all feature groups; these are put together on the daily table,
    so the flights themselves are joined, and shuffled, once.
    """
    grain = list(dict.fromkeys([c for k in keys.values() for c in k]))
    daily = materialized(daily_sums(flights, keys, label, cancelled, date), "daily-history")
    return _join_on(flights, _features(daily, keys, spans, date), [*grain, date], null_safe=True)


def keep_daily_sums(flights: DataFrame, path: str, keys: Mapping[str, Sequence[str]] = HISTORY_KEYS, label: str = "DepDel15", cancelled: str = "Cancelled", date: str = "FlightDate") -> None:
    """Put the daily sums of whole years of flights into the kept table, in place of the same years' earlier ones."""
    sums = daily_sums(flights, keys, label, cancelled, date)
    replace_years(sums.withColumn("year_of_day", F.year(date)), path, "year_of_day")


def add_history_from(
    flights: DataFrame,
    path: str,
    keys: Mapping[str, Sequence[str]] = HISTORY_KEYS,
    spans: Sequence[int] = (7, 30),
    date: str = "FlightDate",
) -> DataFrame:
    """What `add_history` gives for these flights among all flights of the kept table, their own years included.

    Only the days of the flights and the longest span before them are read: older years are
    folders that the scan leaves out.
    """
    grain = list(dict.fromkeys([c for k in keys.values() for c in k]))
    ends = flights.agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    daily = flights.sparkSession.read.parquet(path)
    if ends["first"] is None:
        daily = daily.limit(0)
    else:
        start = ends["first"] - dt.timedelta(days=max(spans))
        daily = daily.filter(F.col("year_of_day").between(start.year, ends["last"].year) & F.col(date).between(start, ends["last"]))
    features = _features(daily.drop("year_of_day"), keys, spans, date)
    return _join_on(flights, features, [*grain, date], null_safe=True)
