"""Reading and writing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylag import schemas
from skylag.session import scratch_path, shared_folder
from skylag.sources import dimensions, flights, sinks
from skylag.sources import weather as weather_files


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Origin,Dest,DepDelay\nJFK,LAX,5\n")
    (tmp_path / "b.csv").write_text("Dest,DepDelay,Origin\nSFO,bad,BOS\n")
    df = flights.read_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), schema=schemas.RAW_FLIGHTS)
    got = {(r["Origin"], r["Dest"], r["DepDelay"]) for r in df.collect()}
    assert got == {("JFK", "LAX", 5.0), ("BOS", "SFO", None)}


def test_monthly_paths_cover_all_months():
    paths = flights.monthly_paths("/data")
    assert len(paths) == 55 and paths[0] == "/data/Flights_2018_1.csv" and paths[-1] == "/data/Flights_2022_7.csv"


def test_monthly_needs_cause_columns(spark, tmp_path):
    path = tmp_path / "Flights_2018_1.csv"
    path.write_text("Origin,CarrierDelay\nJFK,5\n")
    with pytest.raises(ValueError, match="WeatherDelay"):
        flights.read_monthly(spark, [str(path)])


def test_load_year(spark, tmp_path):
    (tmp_path / "Combined_Flights_2018.csv").write_text("Year,Cancelled,Diverted,FlightDate\n2018,0,0,2018-05-01\n2018,1,0,2018-05-01\n2018,,0,2018-05-02\n")
    table, absent = flights.load_year(spark, str(tmp_path), 2018)
    assert table.count() == 2 and "Origin" in absent and "Year" not in absent
    assert len(table.columns) == 28
    with pytest.raises(FileNotFoundError):
        flights.load_year(spark, str(tmp_path), 2019)


def test_parquet_is_preferred_to_csv(spark, tmp_path):
    (tmp_path / "Combined_Flights_2018.csv").write_text("Year\n1\n2\n")
    spark.createDataFrame([(2018, False)], "Year int, Cancelled boolean").write.parquet(str(tmp_path / "Combined_Flights_2018.parquet"))
    assert flights.load_year(spark, str(tmp_path), 2018)[0].count() == 1


def test_boolean_and_numeric_flags(spark, tmp_path):
    df = spark.createDataFrame([(True,), (False,)], "Cancelled boolean")
    assert [r["Cancelled"] for r in schemas.conform(df, schemas.CLEAN_FLIGHTS).collect()] == [1, 0]


def test_write_by_year_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([(2018, 1), (2019, 2)], "Year int, x int")
    sinks.write_by_year(df, str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).filter("Year = 2019")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_counted_write(spark, tmp_path):
    assert sinks.write_counted(spark.range(7), str(tmp_path / "t")) == (7, 1)


def test_sorted_write(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"))
    sinks.write_sorted(df, str(tmp_path / "t"), ["k"])
    files = sorted((tmp_path / "t").glob("part-*"))
    keys = [r["k"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert keys == list(range(100))


def test_report_is_one_file_with_header(spark, tmp_path):
    sinks.write_report(spark.range(3), str(tmp_path / "r"))
    (file,) = (tmp_path / "r").glob("part-*.csv")
    assert file.read_text().splitlines() == ["id", "0", "1", "2"]


def test_airports(spark):
    table = dimensions.airports(spark)
    assert table.count() == 97 and table.select("airport_code").distinct().count() == 97
    jfk = table.filter("airport_code = 'JFK'").first()
    assert (jfk["latitude"], jfk["longitude"], jfk["state"]) == (40.6413, -73.7781, "NY")


def test_hourly_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,temp,dwpt,rhum,prcp,snow,wdir,wspd,wpgt,pres,tsun,coco\n2019-05-06 00:00:00,-3.5,-7.0,61.0,,,120.0,8.5,,1011.0,,\n")
    row = weather_files.read_hourly_csv(spark, str(tmp_path / "w.csv")).first()
    assert row["time"] == dt.datetime(2019, 5, 6) and row["temp"] == -3.5 and row["prcp"] is None


def test_station_series_bounds(spark):
    stamps = [dt.datetime(2017, 12, 31, 23), dt.datetime(2018, 1, 1), dt.datetime(2018, 12, 31, 23), dt.datetime(2019, 1, 1)]
    hourly = spark.createDataFrame([("s", t, 1.0) for t in stamps], "station_id string, time timestamp_ntz, temp double")
    assigned = spark.createDataFrame([("A", "s"), ("B", None), ("C", "other")], "airport_code string, station_id string")
    got = weather_files.land_station_weather(assigned, [hourly], 2018, 2018)
    assert {(r["airport_code"], r["time"]) for r in got.collect()} == {("A", stamps[1]), ("A", stamps[2])}


class _Session:
    """Only what the folder lookup asks a session for."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "test-app"})


def test_scratch_is_below_the_configured_folder():
    session = _Session("/shared/work", "spark://host:7077")
    assert shared_folder(session) == "/shared/work"
    assert scratch_path(session, "x").startswith("/shared/work/x-")
    assert scratch_path(session, "x") != scratch_path(session, "x")


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session(None, "spark://host:7077"))


def test_local_run_keeps_one_fallback_folder():
    session = _Session(None, "local[2]")
    assert shared_folder(session) == shared_folder(session)
