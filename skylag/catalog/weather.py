"""Weather fill, weather join, nearest stations, station series."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.catalog import views
from skylag.catalog.registry import query
from skylag.catalog.views import (
    AIRPORTS_SQL,
    FLIGHT_KEY,
    HASH_BITS,
    NEARBY_SQL,
    STATIONS_SQL,
    WEATHER_SQL,
    with_flights,
    with_views,
)
from skylag.operators import stations, weather
from skylag.operators.sampling import sample_exact
from skylag.plans.feature_table import flights_with_weather
from skylag.sources.dimensions import airports as built_in_airports

MEASURES = ", ".join(fixed.WEATHER_MEASURES)
KEY = ", ".join(FLIGHT_KEY)


def rounded(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in fixed.WEATHER_MEASURES)


FILLED_SQL = f"""filled AS (
    SELECT *, CAST(NULL AS VARCHAR) AS data_source FROM weather_v
    UNION ALL
    SELECT missing AS airport_code, time, {MEASURES}, 'from_' || source
    FROM weather_v JOIN nearby ON airport_code = source
    WHERE NOT EXISTS (SELECT 1 FROM weather_v e WHERE e.airport_code = missing AND e.time = weather_v.time)
)"""
query("j04_missing_hours", with_views(
    "SELECT missing AS airport_code, time, count(*) AS n FROM weather_v JOIN nearby ON airport_code = source "
    "WHERE NOT EXISTS (SELECT 1 FROM weather_v e WHERE e.airport_code = missing AND e.time = weather_v.time) GROUP BY ALL",
    WEATHER_SQL, NEARBY_SQL))(
    lambda spark, sf: weather.missing_hours(
        weather.nearby_rows(views.weather(spark, sf), weather.nearby_map(spark, views.nearby_pairs())), views.weather(spark, sf)
    ).groupBy("airport_code", "time").agg(F.count(F.lit(1)).alias("n")))
query("j05_u03_nearby_fill", with_views(
    f"SELECT airport_code, time, {rounded()}, data_source FROM filled", WEATHER_SQL, NEARBY_SQL, FILLED_SQL))(
    lambda spark, sf: weather.fill_from_nearby(views.weather(spark, sf), weather.nearby_map(spark, views.nearby_pairs())))

ON_HOUR = "Origin = airport_code AND FlightDate = CAST(time AS DATE) AND CRSDepTime // 100 = hour(time)"
query("j01_weather_join", with_flights(
    f"SELECT {KEY}, CRSDepTime // 100 AS dep_hour, {rounded()} FROM flights_v LEFT JOIN weather_v ON {ON_HOUR}", WEATHER_SQL))(
    lambda spark, sf: weather.join_weather(views.flights(spark, sf), views.weather(spark, sf)).select(
        *FLIGHT_KEY, "dep_hour", *fixed.WEATHER_MEASURES))
query("j01_j05_flights_with_filled_weather", with_flights(
    f"SELECT {KEY}, {rounded()} FROM flights_v LEFT JOIN filled ON {ON_HOUR}", WEATHER_SQL, NEARBY_SQL, FILLED_SQL))(
    lambda spark, sf: flights_with_weather(
        views.flights(spark, sf), views.weather(spark, sf), weather.nearby_map(spark, views.nearby_pairs())
    ).select(*FLIGHT_KEY, *fixed.WEATHER_MEASURES))
query("j02_sample_weather_join", with_flights(
    f"SELECT {KEY}, {rounded()} FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY row_hash, {KEY}) AS rn FROM flights_v) "
    f"WHERE rn <= 20000) LEFT JOIN weather_v ON {ON_HOUR}", WEATHER_SQL))(
    lambda spark, sf: weather.join_weather(
        sample_exact(views.flights(spark, sf), 20000, FLIGHT_KEY, rank_by="row_hash", rank_bits=HASH_BITS), views.weather(spark, sf)
    ).select(*FLIGHT_KEY, *fixed.WEATHER_MEASURES))

def _nearest_sql(places: str, k: int) -> str:
    km = (
        "2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(s.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) "
        "* cos(radians(s.latitude)) * pow(sin(radians(s.longitude - a.longitude) / 2), 2))))"
    )
    return (
        "SELECT airport_code, station_id, round(distance_km, 6) AS distance_km, CAST(rank AS INTEGER) AS rank FROM ("
        "SELECT *, row_number() OVER (PARTITION BY airport_code ORDER BY distance_km, station_id) AS rank FROM ("
        f"SELECT a.airport_code, s.station_id, {km} AS distance_km FROM {places} a, stations_v s)) WHERE rank <= {k}"
    )


for _id, _k in (("j10_nearest_station", 1), ("j10_five_nearest_stations", 5)):
    query(_id, with_views(_nearest_sql("airports_v", _k), AIRPORTS_SQL, STATIONS_SQL))(
        lambda spark, sf, k=_k: stations.nearest_stations(views.airports(spark, sf), views.stations(spark, sf), k))

LISTED_SQL = "listed AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{code}', CAST({latitude} AS DOUBLE), CAST({longitude} AS DOUBLE))" for code, _, latitude, longitude, _, _ in fixed.AIRPORTS
) + ") t(airport_code, latitude, longitude))"
query("s07_stations_of_listed_airports", with_views(_nearest_sql("listed", 1), LISTED_SQL, STATIONS_SQL))(
    lambda spark, sf: stations.nearest_stations(built_in_airports(spark), views.stations(spark, sf), 1))

# Each airport reads the hourly series of its station; stations are the users of the events.
query("j11_s16_station_series", with_views(
    "SELECT m.airport_code, time, round(temp, 6) AS temp FROM weather_v JOIN ("
    "SELECT 'NATION_' || (24 - i) AS airport_code, 'NATION_' || i AS station_id FROM range(25) t(i)) m ON weather_v.airport_code = station_id "
    "WHERE time BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2000-12-31 23:00:00'", WEATHER_SQL))(
    lambda spark, sf: _station_series(spark, sf))


def _station_series(spark, sf):
    number = F.col("n_nationkey")
    assignments = views.table(spark, sf, "nation").select(
        F.concat(F.lit("NATION_"), (24 - number).cast("string")).alias("airport_code"),
        F.concat(F.lit("NATION_"), number.cast("string")).alias("station_id"),
    )
    without = spark.createDataFrame([("NO_STATION", None)], assignments.schema)
    assignments = assignments.unionByName(without)
    hourly = views.weather(spark, sf).withColumnRenamed("airport_code", "station_id")
    return weather.station_series(assignments, hourly, 2000, 2000).select("airport_code", "time", "temp")
