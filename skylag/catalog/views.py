"""Flights, hourly weather, airports and stations derived from the given tables.

The same integer arithmetic is written for Spark and as SQL, so both sides see
equal inputs. FLIGHT_KEY identifies a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLIGHT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
HASH_BITS = 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Three layers, so that what several columns share is computed once per row.
FLIGHT_BASE = [
    *FLIGHT_KEY,
    "l_returnflag",
    "l_linestatus",
    "CAST(l_shipdate AS DATE) AS dt",
    "CAST(l_quantity AS INT) * l_linenumber - 60 AS d",
    "(l_orderkey + l_linenumber) % 50 = 0 AS gone",
    "(l_orderkey + l_linenumber) % 97 = 0 AS away",
    "CAST((l_orderkey % 24) * 60 + l_partkey % 60 AS INT) AS sched",
    "CAST(60 + l_partkey % 180 AS INT) AS dur",
    "CAST(l_partkey % 21 - 10 AS INT) AS extra",
    "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709 + l_suppkey * 15485863) % 2147483647 AS row_hash",
]
FLIGHT_CLOCK = [
    "(sched + d + 1440) % 1440 AS dep_m",
    "(sched + d + dur + 1440) % 1440 AS arr_m",
    "(sched + dur) % 1440 AS crs_arr_m",
    "NOT gone AND d >= 15 AS late",
    "NOT gone AND NOT away AS arrived",
]
FLIGHT_COLUMNS = [
    *FLIGHT_KEY,
    "year(dt) AS Year",
    "quarter(dt) AS Quarter",
    "month(dt) AS Month",
    "day(dt) AS DayofMonth",
    "weekday(dt) + 1 AS DayOfWeek",
    "dt AS FlightDate",
    "concat(l_returnflag, l_linestatus) AS Marketing_Airline_Network",
    "CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_suppkey AS STRING) END AS Tail_Number",
    "concat('NATION_', CAST(l_partkey % 25 AS STRING)) AS Dest",
    "CAST((sched DIV 60) * 100 + sched % 60 AS INT) AS CRSDepTime",
    "CAST((crs_arr_m DIV 60) * 100 + crs_arr_m % 60 AS INT) AS CRSArrTime",
    "CAST(CASE WHEN NOT gone THEN (dep_m DIV 60) * 100 + dep_m % 60 END AS DOUBLE) AS DepTime",
    "CAST(CASE WHEN arrived THEN (arr_m DIV 60) * 100 + arr_m % 60 END AS DOUBLE) AS ArrTime",
    "CAST(CASE WHEN NOT gone THEN d END AS DOUBLE) AS DepDelay",
    "CAST(CASE WHEN NOT gone THEN greatest(d, 0) END AS DOUBLE) AS DepDelayMinutes",
    "CASE WHEN NOT gone THEN CAST(d >= 15 AS DOUBLE) END AS DepDel15",
    "CAST(CASE WHEN arrived THEN d + extra END AS DOUBLE) AS ArrDelay",
    "CASE WHEN arrived THEN CAST(d + extra >= 15 AS DOUBLE) END AS ArrDel15",
    "gone AS Cancelled",
    "away AS Diverted",
    *[
        f"CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = {i} THEN d ELSE 0 END END AS DOUBLE) AS {cause}"
        for i, cause in enumerate(["CarrierDelay", "LateAircraftDelay", "NASDelay", "WeatherDelay", "SecurityDelay"])
    ],
    "CAST(100 + (l_partkey * 7 + l_suppkey * 13) % 2400 AS DOUBLE) AS Distance",
    "row_hash",
    "(row_hash % 1000) / CAST(1000 AS DOUBLE) AS score",
]


def flights(spark: SparkSession, sf_dir: str, with_origin: bool = True) -> DataFrame:
    """One flight per order line. Without the origin no join is needed."""
    lines = table(spark, sf_dir, "lineitem")
    origin = []
    if with_origin:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name AS Origin")
        lines = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
            nations, F.col("s_nationkey") == F.col("n_nationkey")
        )
        origin = ["Origin"]
    return lines.selectExpr(*FLIGHT_BASE, *origin).selectExpr("*", *FLIGHT_CLOCK).selectExpr(*FLIGHT_COLUMNS, *origin)


FLIGHTS_SQL = """
flight_base AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, n_name,
           CAST(l_shipdate AS DATE) AS dt,
           CAST(l_quantity AS INTEGER) * l_linenumber - 60 AS d,
           (l_orderkey + l_linenumber) % 50 = 0 AS gone,
           (l_orderkey + l_linenumber) % 97 = 0 AS away,
           (l_orderkey % 24) * 60 + l_partkey % 60 AS sched,
           60 + l_partkey % 180 AS dur,
           (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709 + l_suppkey * 15485863) % 2147483647 AS h
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
flight_clock AS (
    SELECT *, (sched + d + 1440) % 1440 AS dep_m, (sched + d + dur + 1440) % 1440 AS arr_m,
           (sched + dur) % 1440 AS crs_arr_m, NOT gone AND d >= 15 AS late,
           d + l_partkey % 21 - 10 AS ad
    FROM flight_base
),
flights_v AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(year(dt) AS INTEGER) AS Year, CAST(quarter(dt) AS INTEGER) AS Quarter,
           CAST(month(dt) AS INTEGER) AS Month, CAST(day(dt) AS INTEGER) AS DayofMonth,
           CAST(isodow(dt) AS INTEGER) AS DayOfWeek, dt AS FlightDate,
           l_returnflag || l_linestatus AS Marketing_Airline_Network,
           CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS Tail_Number,
           n_name AS Origin, 'NATION_' || CAST(l_partkey % 25 AS VARCHAR) AS Dest,
           CAST((sched // 60) * 100 + sched % 60 AS INTEGER) AS CRSDepTime,
           CAST((crs_arr_m // 60) * 100 + crs_arr_m % 60 AS INTEGER) AS CRSArrTime,
           CAST(CASE WHEN NOT gone THEN (dep_m // 60) * 100 + dep_m % 60 END AS DOUBLE) AS DepTime,
           CAST(CASE WHEN NOT gone AND NOT away THEN (arr_m // 60) * 100 + arr_m % 60 END AS DOUBLE) AS ArrTime,
           CAST(CASE WHEN NOT gone THEN d END AS DOUBLE) AS DepDelay,
           CAST(CASE WHEN NOT gone THEN greatest(d, 0) END AS DOUBLE) AS DepDelayMinutes,
           CASE WHEN NOT gone THEN CAST(d >= 15 AS DOUBLE) END AS DepDel15,
           CAST(CASE WHEN NOT gone AND NOT away THEN ad END AS DOUBLE) AS ArrDelay,
           CASE WHEN NOT gone AND NOT away THEN CAST(ad >= 15 AS DOUBLE) END AS ArrDel15,
           gone AS Cancelled, away AS Diverted,
           CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = 0 THEN d ELSE 0 END END AS DOUBLE) AS CarrierDelay,
           CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = 1 THEN d ELSE 0 END END AS DOUBLE) AS LateAircraftDelay,
           CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = 2 THEN d ELSE 0 END END AS DOUBLE) AS NASDelay,
           CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = 3 THEN d ELSE 0 END END AS DOUBLE) AS WeatherDelay,
           CAST(CASE WHEN late THEN CASE WHEN l_linenumber % 5 = 4 THEN d ELSE 0 END END AS DOUBLE) AS SecurityDelay,
           CAST(100 + (l_partkey * 7 + l_suppkey * 13) % 2400 AS DOUBLE) AS Distance,
           h AS row_hash, (h % 1000) / CAST(1000 AS DOUBLE) AS score
    FROM flight_clock
)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather rows, several per airport and hour, in January 2000."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('NATION_', CAST(user_id % 25 AS STRING)) AS airport_code",
        "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) - INTERVAL 8766 DAYS AS time",
        "value AS temp",
        "CAST(event_id % 31 - 10 AS DOUBLE) AS dwpt",
        "CAST(event_id % 101 AS DOUBLE) AS rhum",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS prcp",
        "CAST(NULL AS DOUBLE) AS snow",
        "CAST(event_id % 360 AS DOUBLE) AS wdir",
        "CAST(event_id % 50 AS DOUBLE) AS wspd",
        "CAST(NULL AS DOUBLE) AS wpgt",
        "CAST(1000 + event_id % 40 AS DOUBLE) AS pres",
        "CAST(NULL AS DOUBLE) AS tsun",
        "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 28 AS DOUBLE) END AS coco",
    )


WEATHER_SQL = """
weather_v AS (
    SELECT 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS airport_code,
           date_trunc('hour', ts) - INTERVAL 8766 DAY AS time,
           value AS temp, CAST(event_id % 31 - 10 AS DOUBLE) AS dwpt, CAST(event_id % 101 AS DOUBLE) AS rhum,
           CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS prcp,
           CAST(NULL AS DOUBLE) AS snow, CAST(event_id % 360 AS DOUBLE) AS wdir, CAST(event_id % 50 AS DOUBLE) AS wspd,
           CAST(NULL AS DOUBLE) AS wpgt, CAST(1000 + event_id % 40 AS DOUBLE) AS pres, CAST(NULL AS DOUBLE) AS tsun,
           CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 28 AS DOUBLE) END AS coco
    FROM events
)"""


def nearby_pairs() -> list[tuple[str, str]]:
    """Even airports are filled from the next odd one."""
    return [(f"NATION_{i}", f"NATION_{i + 1}") for i in range(0, 24, 2)]


NEARBY_SQL = "nearby AS (SELECT 'NATION_' || (2 * i) AS missing, 'NATION_' || (2 * i + 1) AS source FROM range(12) t(i))"


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as airports."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("airport_code"),
        (F.lit(25.0) + F.col("n_nationkey")).cast("double").alias("latitude"),
        (F.lit(-70.0) - F.col("n_nationkey") * 2).cast("double").alias("longitude"),
    )


AIRPORTS_SQL = """
airports_v AS (
    SELECT n_name AS airport_code, CAST(25 + n_nationkey AS DOUBLE) AS latitude,
           CAST(-70 - 2 * n_nationkey AS DOUBLE) AS longitude
    FROM nation
)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as weather stations."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("station_id"),
        (F.lit(25) + (key % 250) / 10).cast("double").alias("latitude"),
        (F.lit(-70) - (key % 600) / 10).cast("double").alias("longitude"),
    )


STATIONS_SQL = """
stations_v AS (
    SELECT s_suppkey AS station_id, 25 + (s_suppkey % 250) / CAST(10 AS DOUBLE) AS latitude,
           -70 - (s_suppkey % 600) / CAST(10 AS DOUBLE) AS longitude
    FROM supplier
)"""


def with_flights(body: str, *more: str) -> str:
    """SQL text over flights_v (and further views)."""
    return "WITH " + ",".join([FLIGHTS_SQL, *more]) + "\n" + body


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body
