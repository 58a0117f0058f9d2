"""Small hand-written cases for the rules that differ between engines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylag import schemas
from skylag.functions import clock, dates, geo, numeric
from skylag.operators import calendar, causes, filters, holidays, propagation, quality, rates, weather
from skylag.operators.holidays import years_between


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_cancelled_nulls(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "Cancelled int")
    assert filters.completed(df).count() == 2
    assert filters.active(df.withColumn("Cancelled", F.col("Cancelled").cast("boolean"))).count() == 1


def test_completed_without_flag_columns(spark):
    assert filters.completed(spark.createDataFrame([(1,)], "x int")).count() == 1


def test_clock(spark):
    df = spark.createDataFrame([(0, "0"), (1, "5"), (2, "930"), (3, "2359"), (4, "2400"), (5, None), (6, "abc")], "i int, t string")
    got = df.orderBy("i").select(clock.clock_hour("t"), clock.clock_minutes("t")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 5), (9, 570), (23, 1439), (24, 1440), (None, None), (None, None)]


def test_timestamp_or_null(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("x",)], "t string")
    assert [r[0] for r in df.select(clock.to_timestamp("t")).collect()] == [dt.datetime(2020, 1, 2, 3, 4, 5), None]
    assert [r[0] for r in df.select(clock.to_timestamp("t", "yyyy-MM-dd HH:mm:ss")).collect()][0] == dt.datetime(2020, 1, 2, 3, 4, 5)


def test_rounding(spark):
    row = spark.range(1).select(numeric.round_half_even(F.lit(0.125).cast("double")), numeric.round_half_up(F.lit(0.125).cast("double"))).first()
    assert tuple(row) == (0.12, 0.13)


def test_safe_ratio(spark):
    row = spark.range(1).select(numeric.ratio_or_zero(F.lit(1), F.lit(0)), numeric.ratio(F.lit(1), F.lit(0)), numeric.ratio_or_zero(F.lit(1), F.lit(4))).first()
    assert tuple(row) == (0.0, None, 0.25)


def test_weekday_numberings(spark):
    sunday = spark.createDataFrame([(dt.date(2022, 11, 20),)], "d date")
    assert tuple(sunday.select(dates.weekday_sunday_first("d"), dates.weekday_monday_first("d")).first()) == (1, 7)


def test_nth_and_last_weekday(spark):
    row = spark.range(1).select(dates.nth_weekday(F.lit(2022), 11, "THU", 4), dates.last_weekday(F.lit(2021), 5, "MON"), dates.nth_weekday(F.lit(2018), 1, "MON", 1)).first()
    assert tuple(row) == (dt.date(2022, 11, 24), dt.date(2021, 5, 31), dt.date(2018, 1, 1))


def test_haversine(spark):
    row = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert row[0] == pytest.approx(3.141592653589793 * 6371, rel=1e-9)


def test_unknown_label_stays_in_denominator(spark):
    df = spark.createDataFrame([(1.0, False), (0.0, False), (None, False), (1.0, True), (1.0, None)], "DepDel15 double, Cancelled boolean")
    row = df.agg(F.count("*")).crossJoin(rates.delay_rate_by(df.withColumn("k", F.lit(1)), "k")).first()
    assert (row["total_flights"], row["delayed_flights"]) == (3, 1.0)
    assert row["delay_rate_pct"] == pytest.approx(100 / 3)


def test_cancelled_flights_are_zero_after_filter(spark):
    df = spark.createDataFrame([(1.0, 20.0, False), (None, None, True)], "DepDel15 double, DepDelayMinutes double, Cancelled boolean")
    assert rates.overall(df).first()["cancelled_flights"] == 0


def test_severity_gaps(spark):
    df = spark.createDataFrame([(15.0,), (30.5,), (31.0,), (240.0,), (241.0,), (None,)], "DepDelayMinutes double")
    got = [r[0] for r in df.select(rates.severity()).collect()]
    assert got == ["15-30分钟", "其他", "31-60分钟", "2-4小时", ">4小时", "其他"]


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "c string")
    assert values(rates.value_counts(df, "c"), "c", "count") == sorted([("a", 1), (None, 2)], key=str)


def test_cause_ranking_keeps_each_causes_own_share(spark):
    rows = [(1.0, False, 100.0, 0.0, 0.0, 0.0, 0.0)] + [(1.0, False, 0.0, 10.0, 0.0, 0.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "DepDel15 double, Cancelled boolean, LateAircraftDelay double, CarrierDelay double, NASDelay double, WeatherDelay double, SecurityDelay double")
    ranking = {r["cause"]: r for r in causes.cause_ranking(causes.cause_table(df)).collect()}
    assert ranking["Late Aircraft"]["rank"] == 1 and ranking["Late Aircraft"]["pct_flights"] == 25.0
    assert ranking["Carrier (Airline)"]["pct_flights"] == 75.0
    security = {r["cause"]: r for r in causes.cause_table(df).collect()}["Security"]
    assert security["total_minutes"] == 0.0 and security["avg_minutes"] is None


def test_cause_table_without_delays(spark):
    df = spark.createDataFrame([(0.0, False, None)], "DepDel15 double, Cancelled boolean, CarrierDelay double")
    row = causes.cause_table(df).first()
    assert (row["total_minutes"], row["flights_affected"], row["pct_minutes"]) == (0.0, 0, None)
    with pytest.raises(ValueError):
        causes.cause_table(df.drop("CarrierDelay"))


def test_calendar_features(spark):
    cases = {
        "2022-11-24": "is_thanksgiving", "2021-05-31": "is_memorial_day", "2022-09-05": "is_labor_day",
        "2022-07-04": "is_july_4th", "2022-01-01": "is_new_year", "2022-12-25": "is_christmas",
    }
    df = spark.createDataFrame([(dt.date.fromisoformat(d), 2400) for d in cases], "FlightDate date, CRSDepTime int")
    for row in calendar.add_calendar_features(df).collect():
        flags = [f for f in cases.values() if row[f] == 1]
        assert flags == [cases[str(row["FlightDate"])]]
        assert row["is_major_holiday"] == 1 and row["dep_hour"] == 24 and row["time_of_day"] == "night"


def test_feature_table_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2022, 5, 1), 2022, 5, 900)], "FlightDate date, Year int, Month int, CRSDepTime int")
    calendar.feature_table(df).write.parquet(str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).first()
    assert (back["Month"], back["fe_month"], back["is_weekend"]) == (5, 5, 1)


def test_features_without_clock(spark):
    df = spark.createDataFrame([(dt.date(2022, 5, 1),)], "FlightDate date")
    assert "dep_hour" not in calendar.add_calendar_features(df).columns


OBSERVED = """
2020-07-03 Independence Day (observed)
2021-06-18 Juneteenth National Independence Day (observed)
2021-07-05 Independence Day (observed)
2021-12-24 Christmas Day (observed)
2021-12-31 New Year's Day (observed)
2018-11-12 Veterans Day (observed)
2022-06-20 Juneteenth National Independence Day (observed)
2022-12-26 Christmas Day (observed)
2023-01-02 New Year's Day (observed)
2023-11-10 Veterans Day (observed)
"""


def test_federal_holidays(spark):
    table = holidays.federal_holidays(years_between(spark, 2018, 2024))
    rows = table.collect()
    assert len(rows) == 84
    observed = sorted(f"{r['date']} {r['holiday_name']}" for r in rows if "observed" in r["holiday_name"])
    assert observed == sorted(OBSERVED.strip().splitlines())
    thanksgiving = [r for r in rows if r["holiday_name"] == "Thanksgiving Day" and r["year"] == 2022][0]
    assert (thanksgiving["is_major_holiday"], thanksgiving["holiday_category"], thanksgiving["impact_level"]) == (0, "Other Holiday", "medium")
    assert (thanksgiving["day_of_week"], thanksgiving["day_of_week_num"]) == ("Thursday", 4)
    fixed = holidays.federal_holidays(years_between(spark, 2022, 2022), fix_names=True)
    by_name = {r["holiday_name"]: r for r in fixed.collect()}
    assert by_name["Thanksgiving Day"]["impact_level"] == "extreme" and by_name["Thanksgiving Day"]["is_major_holiday"] == 1
    assert by_name["Christmas Day (observed)"]["is_major_holiday"] == 1


def test_extended_holidays(spark):
    counts = {r["holiday_name"]: r["count"] for r in holidays.extended_holidays(years_between(spark, 2018, 2024)).groupBy("holiday_name").count().collect()}
    assert sum(counts.values()) == 292
    assert [counts[n] for n in ("Spring Break", "Summer Vacation Peak", "Thanksgiving Week", "Christmas Week")] == [70, 63, 35, 40]


def test_date_dimension(spark):
    dimension = holidays.date_dimension(years_between(spark, 2018, 2024)).cache()
    flags = ["is_holiday", "is_major_holiday", "is_holiday_week_before", "is_holiday_week_after", "is_3days_before_holiday", "is_weekend"]
    assert dimension.count() == 2557
    assert list(rates.flag_totals(dimension, flags).first()) == [292, 110, 1049, 1052, 568, 730]
    picked = dimension.filter(F.col("date").cast("string").isin("2018-01-01", "2022-11-20", "2022-11-24", "2024-12-31"))
    got = {str(r["date"]): (r["days_to_next_holiday"], r["days_from_prev_holiday"]) for r in picked.collect()}
    assert got == {"2018-01-01": (14, 999), "2022-11-20": (1, 9), "2022-11-24": (1, 1), "2024-12-31": (999, 3)}
    dimension.unpersist()


WEATHER = "airport_code string, time timestamp_ntz, temp double"


def hour(h):
    return dt.datetime(2020, 1, 1, h)


def test_nearby_fill_does_not_cascade(spark):
    rows = spark.createDataFrame([("JFK", hour(1), 5.0)], WEATHER)
    mapping = weather.nearby_map(spark)
    got = values(weather.fill_from_nearby(rows, mapping), "airport_code", "data_source")
    assert got == sorted([("ISP", "from_JFK"), ("JFK", None), ("LGA", "from_JFK")], key=str)


def test_nearby_fill_adds_only_missing_hours(spark):
    rows = spark.createDataFrame([("LGA", hour(1), 1.0), ("JFK", hour(1), 2.0), ("JFK", hour(2), 3.0), ("JFK", hour(2), 4.0)], WEATHER)
    filled = weather.fill_from_nearby(rows, weather.nearby_map(spark, [("LGA", "JFK")]))
    lga = values(filled.filter("airport_code = 'LGA'"), "time", "temp", "data_source")
    assert lga == sorted([(hour(1), 1.0, None), (hour(2), 3.0, "from_JFK"), (hour(2), 4.0, "from_JFK")], key=str)
    assert filled.filter("data_source IS NULL").count() == 4


def _flight(origin, date, crs):
    return (origin, date, crs)


def test_weather_join(spark):
    day = dt.date(2020, 1, 1)
    flights = spark.createDataFrame([("A", day, 130), ("A", day, 2400), ("A", None, 130), ("B", day, 130)], "Origin string, FlightDate date, CRSDepTime int")
    rows = spark.createDataFrame([("A", hour(1), 5.0), ("A", hour(1), 6.0), ("A", hour(0), 9.0), ("A", None, 7.0)], WEATHER)
    plain = weather.join_weather(flights, rows, ["temp"])
    assert values(plain, "Origin", "CRSDepTime", "temp") == sorted([("A", 130, 5.0), ("A", 130, 6.0), ("A", 130, None), ("A", 2400, None), ("B", 130, None)], key=str)
    assert "date" not in plain.columns and "hour" not in plain.columns


def test_weather_join_null_safe(spark):
    flights = spark.createDataFrame([("A", None, None)], "Origin string, FlightDate date, CRSDepTime int")
    rows = spark.createDataFrame([("A", None, 7.0)], WEATHER)
    assert weather.join_weather(flights, rows, ["temp"]).first()["temp"] is None
    assert weather.join_weather(flights, rows, ["temp"], null_safe=True).first()["temp"] == 7.0


def test_column_checks(spark):
    df = spark.createDataFrame([(1, 2)], "DepDelay int, dest_wx int")
    assert quality.leakage_columns(df.columns) == ["DepDelay"]
    assert quality.time_travel_columns(df.columns) == ["dest_wx"]
    with pytest.raises(ValueError, match="Year"):
        schemas.require_columns(df, ["Year"])


def test_conform(spark):
    df = spark.createDataFrame([("x", float("nan"), True)], "CRSDepTime string, Distance double, Cancelled boolean")
    row = schemas.conform(df, schemas.CLEAN_FLIGHTS).first()
    assert (row["CRSDepTime"], row["Distance"], row["Cancelled"], row["Origin"]) == (None, None, 1, None)
    assert len(row) == 28


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7.0), (2.0, 2.0, 7.0), (None, 9.0, 7.0), (3.0, None, 7.0), (4.0, 4.5, 7.0)], "x double, y double, c double")
    got = {r["column"]: r["correlation"] for r in quality.correlations(df, "y").collect()}
    assert got["x"] == pytest.approx(0.9986, abs=5e-5) and got["c"] is None
    assert [r["column"] for r in quality.strong_correlations(df, "y").collect()] == ["x"]


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 1.0), (100.0, 3.0), (None, None)], "a double, b double")
    assert {r["column"]: r["median"] for r in quality.medians(df, ["a", "b"]).collect()} == {"a": 3.0, "b": 3.0}


def test_null_profile_and_completeness(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, "x")], "a int, b string")
    profile = quality.null_profile(df, ["a", "b", "absent"])
    assert values(profile, "column", "missing_count", "missing_pct") == [("a", 1, 33.33), ("b", 2, 66.67)]
    assert quality.completeness(profile).first()[0] == pytest.approx(50.0)


FLIGHTS = "Year int, FlightDate date, Origin string, Dest string, DepTime double, ArrTime double, ArrDelay double, ArrDel15 double"


def clocked(minutes):
    return None if minutes is None else float(minutes // 60 * 100 + minutes % 60)


def movements(spark, departures, arrivals, airport="A"):
    day = dt.date(2020, 1, 1)
    rows = [(2020, day, airport, "X", clocked(d), None, None, None) for d in departures]
    rows += [(2020, day, "Y", airport, None, clocked(a), delay, late) for a, delay, late in arrivals]
    return spark.createDataFrame(rows, FLIGHTS)


def late_at(df, airport="A"):
    got = propagation.add_recent_arrival_features(df).filter(F.col("Origin") == airport)
    return {r["DepTime_minutes"]: (r["origin_delay_rate_past2h"], r["origin_arr_delay_avg_past2h"], r["origin_late_arrivals_past2h"]) for r in got.collect()}


def test_trailing_window(spark):
    got = late_at(movements(spark, [120, 230, None], [(100, 30.0, 1.0), (220, 40.0, 1.0), (None, 50.0, 1.0)]))
    assert got == {120.0: (1.0, 30.0, 1.0), 230.0: (1.0, 40.0, 1.0), None: (0.0, 0.0, 0.0)}


def test_trailing_window_edges(spark):
    got = late_at(movements(spark, [240], [(119, 1.0, 1.0), (120, 1.0, 1.0), (239, 1.0, 1.0), (240, 1.0, 1.0)]))
    assert got[240.0][2] == 2.0


def test_unknown_arrival_delay_counts_as_punctual(spark):
    got = late_at(movements(spark, [240], [(200, 30.0, 1.0), (210, None, None)]))
    assert got[240.0] == (0.5, 15.0, 1.0)


def test_no_arrivals_and_unknown_origin(spark):
    df = movements(spark, [240], []).unionByName(movements(spark, [240], [], airport=None))
    got = propagation.add_recent_arrival_features(df).collect()
    features = {r["Origin"]: (r["origin_delay_rate_past2h"], r["origin_late_arrivals_past2h"]) for r in got}
    assert features == {"A": (0.0, 0.0), None: (None, None)}


def test_roll_midnight(spark):
    df = spark.createDataFrame([(2020, dt.date(2020, 1, 1), "A", "B", 2330.0, 30.0, 0.0, 0.0)], FLIGHTS)
    plain = propagation.add_timestamps(df).first()
    rolled = propagation.add_timestamps(df, roll_midnight=True).first()
    assert rolled["ArrTimestamp"] - plain["ArrTimestamp"] == 1440.0


LEGS = "Tail_Number string, FlightDate date, CRSDepTime int, ArrDelay double, Cancelled boolean, id int"


def test_previous_leg(spark):
    day = dt.date(2020, 1, 1)
    rows = [("T", day, 800, 20.0, False, 1), ("T", day, 900, 5.0, False, 2), ("T", day, 1200, None, False, 3), (None, day, 700, 9.0, False, 4)]
    got = propagation.previous_leg(spark.createDataFrame(rows, LEGS), ["id"]).orderBy("id").collect()
    assert [r["prev_arr_delay"] for r in got] == [None, 20.0, 5.0]


def test_calendar_with_dates_far_away(spark):
    """Two lone dates add two years, not the millennia between them."""
    days = [dt.date(1, 7, 1), dt.date(2020, 12, 31), dt.date(2021, 1, 2), dt.date(9999, 12, 30)]
    flights = spark.createDataFrame([(d,) for d in days], "FlightDate date")
    years = holidays.years_of(flights)
    assert sorted(r["year"] for r in years.collect()) == [1, 2020, 2021, 9999]
    dimension = holidays.date_dimension(years)
    assert dimension.count() == 365 + 366 + 365 + 365
    got = {r["FlightDate"]: (r["days_to_next_holiday"], r["days_from_prev_holiday"]) for r in holidays.join_calendar(flights, dimension, ["days_to_next_holiday", "days_from_prev_holiday"]).collect()}
    assert got[dt.date(2020, 12, 31)] == (1, 3) and got[dt.date(2021, 1, 2)][1] == 1
    assert got[dt.date(9999, 12, 30)] == (1, 2)  # a New Year observed on December 31


def test_holiday_tables_come_by_date(spark):
    for table in (holidays.federal_holidays, holidays.extended_holidays):
        dates = [r["date"] for r in table(years_between(spark, 2018, 2024)).collect()]
        assert dates == sorted(dates)
