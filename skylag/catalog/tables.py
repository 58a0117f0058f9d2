"""Sources and sinks: tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag import schemas
from skylag.catalog import views
from skylag.catalog.causes_and_rates import FLOWN, RATE_AVG
from skylag.catalog.registry import query
from skylag.catalog.selections import kept_rows
from skylag.catalog.views import with_flights, with_views
from skylag.operators import rates
from skylag.session import materialized, scratch_path
from skylag.sources import dimensions, flights, sinks
from skylag.sources import weather as weather_files

no_origin = partial(views.flights, with_origin=False)
CENSUS = "SELECT Year, Month, count(*) AS n, round(sum(Distance), 6) AS distance FROM flights_v {} GROUP BY ALL"


def census(df):
    return df.groupBy("Year", "Month").agg(F.count(F.lit(1)).alias("n"), F.sum("Distance").alias("distance"))


def as_published(df):
    """The view under the published clean schema plus the raw columns."""
    return schemas.conform(df, schemas.RAW_FLIGHTS)


query("s01_several_files_as_one", (
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY 1"))(
    lambda spark, sf: flights.read_parquet(spark, f"{sf}/lineitem.parquet", f"{sf}/lineitem.parquet")
    .groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))
query("s02_one_file", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda spark, sf: flights.read_parquet(spark, f"{sf}/lineitem.parquet").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n")))


@query("s03_year_from_parquet_or_csv", with_flights(CENSUS.format("WHERE NOT Cancelled AND NOT Diverted")))
def _years_from_files(spark, sf):
    """All years, parquet and CSV in turn."""
    folder = scratch_path(spark, "years")
    table = materialized(as_published(no_origin(spark, sf)), "published")
    years = sorted(r["Year"] for r in table.select("Year").distinct().collect())
    for i, year in enumerate(years):
        own = table.filter(F.col("Year") == year)
        if i % 2:
            own.write.option("header", True).csv(f"{folder}/Combined_Flights_{year}.csv")
        else:
            sinks.write_table(own, f"{folder}/Combined_Flights_{year}.parquet")
    return census(flights.load_years(spark, folder, years))


@query("s04_s05_monthly_csv", with_flights(CENSUS.format("")))
def _monthly(spark, sf):
    """One CSV folder per month, all months; every other month has its columns in another order."""
    table = as_published(no_origin(spark, sf)).withColumns({"y": F.col("Year"), "m": F.col("Month")})
    table = materialized(table, "published")
    months = sorted((r["y"], r["m"]) for r in table.select("y", "m").distinct().collect())
    folders = [scratch_path(spark, "monthly") for _ in range(2)]
    for turn, folder in enumerate(folders):
        columns = table.columns[:-2][:: 1 if turn == 0 else -1]
        own = table.filter((F.col("y") * 12 + F.col("m")) % 2 == turn).select(*columns, "y", "m")
        own.hint("rebalance", "y", "m").write.partitionBy("y", "m").option("header", True).csv(folder)
    paths = [f"{folders[(y * 12 + m) % 2]}/y={y}/m={m}" for y, m in months]
    return census(flights.read_monthly(spark, paths))


@query("s06_csv_dimension", with_views("SELECT airport_code, latitude, longitude FROM airports_v", views.AIRPORTS_SQL))
def _dimension(spark, sf):
    path = scratch_path(spark, "airports")
    wide = schemas.conform(views.airports(spark, sf), schemas.AIRPORTS)
    sinks.write_report(wide, path)
    return dimensions.read_dimension(spark, path, schemas.AIRPORTS).select("airport_code", "latitude", "longitude")


@query("s08_p08_year_folders", with_flights(CENSUS.format("WHERE Year = 1999")))
def _year_folders(spark, sf):
    path = scratch_path(spark, "by-year")
    sinks.write_by_year(no_origin(spark, sf), path)
    return census(flights.read_parquet(spark, path).filter("Year = 1999"))


@query("s08_one_year_replaced", with_flights(CENSUS.format("WHERE Year <> 1999 OR NOT Cancelled")))
def _year_replaced(spark, sf):
    """All years written, one of them replaced in place, twice."""
    path = scratch_path(spark, "by-year")
    table = no_origin(spark, sf)
    sinks.write_by_year(table, path)
    for _ in range(2):
        sinks.replace_years(table.filter("Year = 1999 AND NOT Cancelled"), path)
    return census(flights.read_parquet(spark, path))


@query("s09_s14_counted_write", with_flights("SELECT count(*) AS written, 32 AS columns, count(*) AS read_back FROM flights_v"))
def _counted(spark, sf):
    path = scratch_path(spark, "whole")
    rows, columns = sinks.write_counted(no_origin(spark, sf), path)
    return flights.read_parquet(spark, path).agg(
        F.lit(rows).cast("bigint").alias("written"), F.lit(columns).alias("columns"), F.count(F.lit(1)).alias("read_back"))


@query("s10_s11_csv_report", with_flights(f"SELECT Year, {RATE_AVG} {FLOWN} GROUP BY Year"))
def _report(spark, sf):
    path = scratch_path(spark, "report")
    report = rates.by_year(no_origin(spark, sf))
    sinks.write_report(report, path)
    return dimensions.read_dimension(spark, path, report.schema)


query("s13_s14_shape", with_flights("SELECT count(*) AS rows, 32 AS columns FROM flights_v"))(
    lambda spark, sf: sinks.shape(no_origin(spark, sf)))
query("s15_preview", with_flights("SELECT least(10, count(*)) AS n, least(10, count(*)) AS known FROM flights_v"))(
    lambda spark, sf: kept_rows(sinks.preview(no_origin(spark, sf), 10), no_origin(spark, sf)))


@query("o04_sorted_write", with_views("SELECT airport_code, time, count(*) AS n FROM weather_v GROUP BY ALL", views.WEATHER_SQL))
def _sorted(spark, sf):
    path = scratch_path(spark, "weather")
    sinks.write_sorted(views.weather(spark, sf), path, ["airport_code", "time"])
    return weather_files.read_hourly_parquet(spark, path).groupBy("airport_code", "time").agg(F.count(F.lit(1)).alias("n"))


@query("u05_s16_station_files", with_views(
    "SELECT airport_code, count(*) AS n, count(coco) AS with_code FROM weather_v WHERE year(time) = 2000 GROUP BY 1", views.WEATHER_SQL))
def _station_files(spark, sf):
    """Two landed files, one per half of the airports, joined to their own station names."""
    hourly = views.weather(spark, sf).withColumnRenamed("airport_code", "station_id")
    early, late = scratch_path(spark, "stations"), scratch_path(spark, "stations")
    sinks.write_table(hourly.filter("station_id < 'NATION_2'"), early)
    sinks.write_table(hourly.filter("station_id >= 'NATION_2'"), late)
    files = [spark.read.parquet(early), spark.read.parquet(late)]
    own = views.airports(spark, sf).select("airport_code", F.col("airport_code").alias("station_id"))
    landed = weather_files.land_station_weather(own, files, 2000, 2000)
    return landed.groupBy("airport_code").agg(F.count(F.lit(1)).alias("n"), F.count("coco").alias("with_code"))
