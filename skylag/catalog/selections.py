"""Filters, projections, sorts, samples, splits and set operations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag import schemas
from skylag.catalog import views
from skylag.catalog.registry import query
from skylag.catalog.views import FLIGHT_KEY, HASH_BITS, with_flights, with_views
from skylag.models import prep
from skylag.operators import filters, rates, sampling
from skylag.sources.flights import union_by_name

no_origin = partial(views.flights, with_origin=False)
KEY = ", ".join(FLIGHT_KEY)


def per_year(df):
    return df.groupBy("Year").agg(F.count(F.lit(1)).alias("n"))


PER_YEAR = "SELECT Year, count(*) AS n FROM flights_v WHERE {} GROUP BY Year"

query("p01_existing_columns", with_flights("SELECT Year, Distance FROM flights_v"))(
    lambda spark, sf: filters.keep_existing(no_origin(spark, sf), ["Year", "Altitude", "Distance"])[0])
query("p02_projection", with_flights(f"SELECT {KEY}, FlightDate, CRSDepTime FROM flights_v"))(
    lambda spark, sf: no_origin(spark, sf).select(*FLIGHT_KEY, "FlightDate", "CRSDepTime"))
query("p03_drop_columns", with_views("SELECT airport_code, time, temp, dwpt, rhum, prcp, wdir, wspd, pres, coco FROM weather_v", views.WEATHER_SQL))(
    lambda spark, sf: filters.without_columns(views.weather(spark, sf), ["snow", "wpgt", "tsun", "__index_level_0__"]))
query("p04_rename", with_views("SELECT airport_code AS Origin, time AS observed, temp FROM weather_v", views.WEATHER_SQL))(
    lambda spark, sf: filters.rename(views.weather(spark, sf), {"airport_code": "Origin", "time": "observed"}).select("Origin", "observed", "temp"))
query("p05_active", with_flights(PER_YEAR.format("NOT Cancelled")))(lambda spark, sf: per_year(filters.active(no_origin(spark, sf))))


@query("p06_completed_keeps_unknown", with_flights(
    "SELECT Year, count(*) AS n FROM flights_v WHERE (CASE WHEN l_linenumber = 7 THEN NULL ELSE Cancelled END) IS DISTINCT FROM true "
    "AND NOT Diverted GROUP BY Year"))
def _completed(spark, sf):
    df = no_origin(spark, sf).withColumn("Cancelled", F.when(F.col("l_linenumber") != 7, F.col("Cancelled").cast("int")))
    return per_year(filters.completed(df))


query("p07_delayed", with_flights(PER_YEAR.format("DepDel15 = 1 AND NOT Cancelled")))(
    lambda spark, sf: per_year(filters.delayed(no_origin(spark, sf))))
query("p08_one_year", with_flights("SELECT Month, count(*) AS n FROM flights_v WHERE Year = 1998 GROUP BY Month"))(
    lambda spark, sf: filters.in_year(no_origin(spark, sf), 1998).groupBy("Month").agg(F.count(F.lit(1)).alias("n")))
query("p08_one_year_of_time", with_views("SELECT airport_code, count(*) AS n FROM weather_v WHERE year(time) = 2000 GROUP BY 1", views.WEATHER_SQL))(
    lambda spark, sf: rates.value_counts(filters.in_year_of(views.weather(spark, sf), 2000), "airport_code").withColumnRenamed("count", "n"))
query("p09_known_values", with_flights(PER_YEAR.format("ArrTime IS NOT NULL AND Tail_Number IS NOT NULL")))(
    lambda spark, sf: per_year(filters.known(no_origin(spark, sf), "ArrTime", "Tail_Number")))
query("p10_minimum_group", with_flights("SELECT Dest, count(*) AS count FROM flights_v GROUP BY 1 HAVING count(*) >= 2400"))(
    lambda spark, sf: filters.at_least(rates.value_counts(no_origin(spark, sf), "Dest"), "count", 2400))
query("p11_date_range", with_flights(
    "SELECT FlightDate, count(*) AS n FROM flights_v WHERE FlightDate BETWEEN DATE '1998-11-20' AND DATE '1998-11-28' GROUP BY 1"))(
    lambda spark, sf: filters.in_date_range(no_origin(spark, sf), "1998-11-20", "1998-11-28", "FlightDate")
    .groupBy("FlightDate").agg(F.count(F.lit(1)).alias("n")))
query("p12_membership", with_flights(PER_YEAR.format("Dest IN ('NATION_3', 'NATION_17')")))(
    lambda spark, sf: per_year(no_origin(spark, sf).filter(filters.member_of("Dest", ["NATION_3", "NATION_17"]))))
query("p13_constant_columns", with_flights(
    "SELECT 'lineitem' AS source, 'from_' || Dest AS data_source, count(*) AS n FROM flights_v GROUP BY ALL"))(
    lambda spark, sf: no_origin(spark, sf)
    .groupBy(F.lit("lineitem").alias("source"), F.concat(F.lit("from_"), "Dest").alias("data_source"))
    .agg(F.count(F.lit(1)).alias("n")))
query("p14_text_columns", with_flights("SELECT Marketing_Airline_Network, Tail_Number, Dest FROM flights_v"))(
    lambda spark, sf: no_origin(spark, sf).select(*schemas.text_columns(no_origin(spark, sf))))
query("p15_drop_by_keyword", with_flights(
    f"SELECT {KEY}, Year, Quarter, Month, DayofMonth, DayOfWeek, FlightDate, Marketing_Airline_Network, Tail_Number, Dest, Distance, row_hash, score FROM flights_v"))(
    lambda spark, sf: filters.without_columns_named_like(no_origin(spark, sf), ["Time", "Delay", "Del15", "Cancelled", "Diverted"]))


@query("p16_step_if_column_exists", with_flights("SELECT Year, Quarter, count(*) AS n FROM flights_v GROUP BY ALL"))
def _guarded(spark, sf):
    df = no_origin(spark, sf)
    keys = [c for c in ("Year", "Quarter", "Fortnight") if schemas.has_columns(df, c)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


query("p17_features_and_label", with_flights("SELECT Distance, CRSDepTime, DepDel15 AS label FROM flights_v"))(
    lambda spark, sf: filters.features_and_label(no_origin(spark, sf).select("Distance", "CRSDepTime", "DepDel15"), "DepDel15"))
query("p18_lookup", with_views("SELECT airport_code, latitude, longitude FROM airports_v WHERE airport_code = 'NATION_7'", views.AIRPORTS_SQL))(
    lambda spark, sf: filters.lookup(views.airports(spark, sf), "airport_code", "NATION_7", ["airport_code", "latitude", "longitude"]))

query("o01_sorted_keys", with_flights("SELECT Year, Month, count(*) AS n FROM flights_v GROUP BY ALL"))(
    lambda spark, sf: no_origin(spark, sf).groupBy("Year", "Month").agg(F.count(F.lit(1)).alias("n")).orderBy("Year", "Month"))
query("o02_top_k", with_flights(f"SELECT {KEY}, DepDelay FROM flights_v ORDER BY DepDelay DESC NULLS LAST, {KEY} LIMIT 25"))(
    lambda spark, sf: filters.top(no_origin(spark, sf).select(*FLIGHT_KEY, "DepDelay"), 25, "DepDelay", FLIGHT_KEY))
def kept_rows(some, source):
    """How many rows a limit gave, and how many of them the source has."""
    marked = some.join(source.select(*FLIGHT_KEY).distinct().withColumn("known", F.lit(1)), FLIGHT_KEY, "left")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))


query("o06_limit", with_flights("SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS known FROM flights_v"))(
    lambda spark, sf: kept_rows(no_origin(spark, sf).select(*FLIGHT_KEY).limit(1000), no_origin(spark, sf)))

SAMPLED = "SELECT {cols} FROM (SELECT *, row_number() OVER (ORDER BY row_hash, " + KEY + ") AS rn FROM flights_v) WHERE rn <= 20000"
query("o07_exact_sample", with_flights(SAMPLED.format(cols=KEY)))(
    lambda spark, sf: sampling.sample_exact(no_origin(spark, sf), 20000, FLIGHT_KEY, rank_by="row_hash", rank_bits=HASH_BITS).select(*FLIGHT_KEY))
query("o08_stratified_split", with_flights(f"""SELECT {KEY}, DepDel15,
       CASE WHEN row_number() OVER (PARTITION BY DepDel15 ORDER BY row_hash, {KEY})
                 <= floor(count(*) OVER (PARTITION BY DepDel15) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM flights_v"""))(
    lambda spark, sf: sampling.stratified_split(
        no_origin(spark, sf).select(*FLIGHT_KEY, "DepDel15", "row_hash"), "DepDel15", FLIGHT_KEY, rank_by="row_hash", rank_bits=HASH_BITS
    ).drop("row_hash"))
_TRAIN_ROWS = "floor(count(*) * CAST(0.8 AS DOUBLE))"
query("o08_stratified_split_counts", with_flights(
    f"SELECT DepDel15, 'train' AS split, CAST({_TRAIN_ROWS} AS BIGINT) AS n FROM flights_v GROUP BY 1 "
    f"UNION ALL SELECT DepDel15, 'test', CAST(count(*) - {_TRAIN_ROWS} AS BIGINT) FROM flights_v GROUP BY 1"))(
    lambda spark, sf: sampling.stratified_split(no_origin(spark, sf), "DepDel15", FLIGHT_KEY)
    .groupBy("DepDel15", "split").agg(F.count(F.lit(1)).alias("n")))
query("o09_split_by_year", with_flights(
    "SELECT CASE WHEN Year <= 1997 THEN 'train' WHEN Year = 1998 THEN 'validation' ELSE 'test' END AS split, count(*) AS n "
    "FROM flights_v GROUP BY 1"))(
    lambda spark, sf: sampling.split_by_year(no_origin(spark, sf), range(1990, 1998), (1998,), range(1999, 2010))
    .groupBy("split").agg(F.count(F.lit(1)).alias("n")))

query("u01_union_by_name", with_flights(
    "SELECT Year, Dest, count(*) AS n FROM (SELECT Year, Dest FROM flights_v WHERE Year < 1998 UNION ALL "
    "SELECT Year, Dest FROM flights_v WHERE Year >= 1998) GROUP BY ALL"))(
    lambda spark, sf: no_origin(spark, sf).select("Year", "Dest").filter("Year < 1998")
    .unionByName(no_origin(spark, sf).select("Dest", "Year").filter("Year >= 1998"))
    .groupBy("Year", "Dest").agg(F.count(F.lit(1)).alias("n")))
query("u02_union_with_missing_columns", with_flights(
    "SELECT Year, count(Dest) AS known, count(*) AS n FROM (SELECT Year, Dest FROM flights_v WHERE Year < 1998 UNION ALL "
    "SELECT Year, NULL FROM flights_v WHERE Year >= 1998) GROUP BY ALL"))(
    lambda spark, sf: union_by_name(
        no_origin(spark, sf).select("Year", "Dest").filter("Year < 1998"), no_origin(spark, sf).select("Year").filter("Year >= 1998")
    ).groupBy("Year").agg(F.count("Dest").alias("known"), F.count(F.lit(1)).alias("n")))


@query("u06_unseen_values", with_flights(
    "SELECT DISTINCT Dest || '@' || CAST(CRSDepTime AS VARCHAR) AS slot FROM flights_v WHERE Year >= 1998 EXCEPT "
    "SELECT Dest || '@' || CAST(CRSDepTime AS VARCHAR) FROM flights_v WHERE Year < 1998"))
def _unseen_slots(spark, sf):
    slots = no_origin(spark, sf).select("Year", F.concat("Dest", F.lit("@"), F.col("CRSDepTime").cast("string")).alias("slot"))
    return prep.unseen_values(slots.filter("Year >= 1998"), slots.filter("Year < 1998"), "slot")
