"""Scalar functions over whole columns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag.catalog import views
from skylag.catalog.registry import query
from skylag.catalog.views import AIRPORTS_SQL, STATIONS_SQL, with_flights, with_views
from skylag.functions import clock, dates, geo, numeric
from skylag.operators import rates

no_origin = partial(views.flights, with_origin=False)


def counted(source, **columns):
    """Rows per combination of the computed columns."""
    return lambda spark, sf: source(spark, sf).groupBy(
        *[make().alias(name) for name, make in columns.items()]
    ).agg(F.count(F.lit(1)).alias("n"))


def counted_sql(**columns: str) -> str:
    items = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {items}, count(*) AS n FROM flights_v GROUP BY ALL"


HHMM_MINUTES = "CAST((CAST({c} AS INTEGER) // 100) * 60 + CAST({c} AS INTEGER) % 100 AS INTEGER)"

query("f01_clock_hour", with_flights(counted_sql(
    crs_hour="CRSDepTime // 100", dep_hour="CAST(DepTime AS INTEGER) // 100")))(
    counted(no_origin, crs_hour=lambda: clock.clock_hour("CRSDepTime"), dep_hour=lambda: clock.clock_hour("DepTime")))
query("f02_clock_minutes", with_flights(counted_sql(minutes=HHMM_MINUTES.format(c="ArrTime"))))(
    counted(no_origin, minutes=lambda: clock.clock_minutes("ArrTime")))
query("f03_epoch_minutes", with_flights(
    "SELECT Year, min(t) AS first_minute, max(t) AS last_minute, count(t) AS n, CAST(sum(t) AS BIGINT) AS total FROM ("
    "SELECT Year, CAST(date_diff('day', DATE '1970-01-01', FlightDate) AS BIGINT) * 1440 + "
    + HHMM_MINUTES.format(c="DepTime") + " AS t FROM flights_v) GROUP BY Year"))(
    lambda spark, sf: no_origin(spark, sf)
    .select("Year", clock.epoch_minutes("FlightDate", "DepTime").alias("t"))
    .groupBy("Year")
    .agg(F.min("t").alias("first_minute"), F.max("t").alias("last_minute"), F.count("t").alias("n"), F.sum("t").alias("total")))
query("f04_number_or_null", with_flights(counted_sql(
    tail="TRY_CAST(Tail_Number AS DOUBLE)", airline="TRY_CAST(Marketing_Airline_Network AS DOUBLE)")))(
    counted(no_origin, tail=lambda: clock.to_number("Tail_Number"), airline=lambda: clock.to_number("Marketing_Airline_Network")))
query("f05_timestamp_or_null", with_flights(counted_sql(
    stamp="TRY_CAST(CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE CAST(FlightDate AS VARCHAR) || ' 05:00:00' END AS TIMESTAMP)")))(
    counted(no_origin, stamp=lambda: clock.to_timestamp(
        F.when(F.col("l_linenumber") == 1, "unknown").otherwise(F.concat(F.col("FlightDate").cast("string"), F.lit(" 05:00:00"))))))
query("f06_date_hour_year_of_time", with_views(
    "SELECT CAST(time AS DATE) AS date, CAST(hour(time) AS INTEGER) AS hour, CAST(year(time) AS INTEGER) AS year, count(*) AS n "
    "FROM weather_v GROUP BY ALL", views.WEATHER_SQL))(
    counted(views.weather, date=lambda: F.to_date("time"), hour=lambda: F.hour("time"), year=lambda: F.year("time")))
query("f07_date_parts", with_flights(counted_sql(
    month="Month", day="DayofMonth", quarter="Quarter", week="CAST(weekofyear(FlightDate) AS INTEGER)")))(
    counted(no_origin, month=lambda: F.month("FlightDate"), day=lambda: F.dayofmonth("FlightDate"),
            quarter=lambda: F.quarter("FlightDate"), week=lambda: F.weekofyear("FlightDate")))
query("f08_weekday_sunday_first", with_flights(counted_sql(dow="CAST(dayofweek(FlightDate) + 1 AS INTEGER)")))(
    counted(no_origin, dow=lambda: dates.weekday_sunday_first("FlightDate")))
query("f09_weekday_monday_first", with_flights(counted_sql(dow="CAST(isodow(FlightDate) AS INTEGER)")))(
    counted(no_origin, dow=lambda: dates.weekday_monday_first("FlightDate")))
query("f10_day_name_and_iso_text", with_flights(counted_sql(
    name="dayname(FlightDate)", text="strftime(FlightDate, '%Y-%m-%d')")))(
    counted(no_origin, name=lambda: dates.weekday_name("FlightDate"), text=lambda: dates.iso_date("FlightDate")))
query("f11_text_to_date", with_flights(counted_sql(
    date="TRY_CAST(CASE WHEN l_linenumber = 2 THEN 'soon' ELSE strftime(FlightDate, '%Y-%m-%d') END AS DATE)")))(
    counted(no_origin, date=lambda: dates.parse_date(
        F.when(F.col("l_linenumber") == 2, "soon").otherwise(dates.iso_date("FlightDate")))))
query("f12_date_difference_and_shift", with_flights(counted_sql(
    days="CAST(date_diff('day', make_date(Year, 1, 1), FlightDate) AS INTEGER)", week_later="CAST(FlightDate + INTERVAL 7 DAY AS DATE)")))(
    counted(no_origin, days=lambda: dates.days_between("FlightDate", F.make_date("Year", F.lit(1), F.lit(1))),
            week_later=lambda: F.date_add("FlightDate", 7)))
query("f13_daily_sequence", with_flights(
    "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date "
    "FROM (SELECT CAST(min(FlightDate) AS TIMESTAMP) AS a, CAST(max(FlightDate) AS TIMESTAMP) AS b FROM flights_v)"))(
    lambda spark, sf: no_origin(spark, sf)
    .agg(F.min("FlightDate").alias("a"), F.max("FlightDate").alias("b"))
    .select(F.explode(dates.date_range(F.col("a"), F.col("b"))).alias("date")))
query("f14_route_text", with_flights(counted_sql(route="Origin || '-' || Dest")))(
    counted(views.flights, route=lambda: rates.route()))
query("f16_branches", with_flights(counted_sql(
    period="CASE WHEN Year = 1998 THEN 'in' WHEN Year < 1998 THEN 'before' ELSE 'after' END")))(
    counted(no_origin, period=lambda: rates.period("Year", 1998, ("before", "in", "after"))))
query("f17_between", with_flights(counted_sql(midday="CRSDepTime BETWEEN 1100 AND 1300")))(
    counted(no_origin, midday=lambda: F.col("CRSDepTime").between(1100, 1300)))
query("f18_indicator", with_flights(counted_sql(has_carrier_delay="CASE WHEN CarrierDelay > 0 THEN 1 ELSE 0 END")))(
    counted(no_origin, has_carrier_delay=lambda: numeric.indicator(F.col("CarrierDelay") > 0)))
query("f19_flag_to_integer", with_flights(counted_sql(cancelled="CAST(Cancelled AS INTEGER)")))(
    counted(no_origin, cancelled=lambda: F.col("Cancelled").cast("int")))
query("f20_fill_null", with_flights(counted_sql(late="coalesce(ArrDel15, CAST(0 AS DOUBLE))")))(
    counted(no_origin, late=lambda: numeric.fill_null("ArrDel15", 0.0)))
query("f21_safe_ratio", with_flights(
    "SELECT Dest, round(CASE WHEN sum(SecurityDelay) FILTER (Year = 1995) > 0 "
    "THEN sum(WeatherDelay) / sum(SecurityDelay) FILTER (Year = 1995) ELSE 0 END, 6) AS ratio FROM flights_v GROUP BY Dest"))(
    lambda spark, sf: no_origin(spark, sf).groupBy("Dest").agg(
        numeric.ratio_or_zero(F.sum("WeatherDelay"), F.coalesce(F.sum(F.when(F.col("Year") == 1995, F.col("SecurityDelay"))), F.lit(0.0))).alias("ratio")))
query("f22_rounding", with_flights(counted_sql(
    half_up="round(Distance / 8, 2)", half_even="CAST(round_even(Distance / 8, 2) AS DOUBLE)")))(
    counted(no_origin, half_up=lambda: numeric.round_half_up(F.col("Distance") / 8),
            half_even=lambda: numeric.round_half_even(F.col("Distance") / 8)))
query("f24_great_circle", with_views(
    "SELECT airport_code, count(*) AS n, round(min(km), 6) AS nearest, round(max(km), 6) AS farthest FROM ("
    "SELECT a.airport_code, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(s.latitude - a.latitude) / 2), 2) "
    "+ cos(radians(a.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - a.longitude) / 2), 2))) AS km "
    "FROM airports_v a JOIN supplier ON s_nationkey = CAST(replace(a.airport_code, 'NATION_', '') AS INTEGER) "
    "JOIN stations_v s ON s.station_id = s_suppkey) GROUP BY 1", AIRPORTS_SQL, STATIONS_SQL))(
    lambda spark, sf: _own_station_distances(spark, sf))


def _own_station_distances(spark, sf):
    """Distance of each airport to the stations of its own nation."""
    places = views.airports(spark, sf).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    owners = views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("airport_code"))
    pairs = places.join(owners, "airport_code").join(views.stations(spark, sf), "station_id")
    measured = pairs.withColumn("km", geo.haversine_km("lat", "lon", "latitude", "longitude"))
    return measured.groupBy("airport_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("km").alias("nearest"), F.max("km").alias("farthest"))
