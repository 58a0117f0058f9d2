"""Calendar features of flights and holiday tables built for the flights' own years."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag.catalog import views
from skylag.catalog.causes_and_rates import FLAG_SQL, RATE
from skylag.catalog.registry import query
from skylag.catalog.views import with_flights
from skylag.functions.dates import nth_weekday
from skylag.operators import holidays
from skylag.operators.calendar import add_calendar_features, feature_table
from skylag.operators.rates import delay_rate_by, flag_totals

no_origin = partial(views.flights, with_origin=False)

DATE_PART_SQL = (
    "Month AS fe_month, DayofMonth AS day_of_month, CAST(dayofweek(FlightDate) + 1 AS INTEGER) AS day_of_week, "
    "Quarter AS fe_quarter, CAST(weekofyear(FlightDate) AS INTEGER) AS week_of_year"
)


def _counted_features(*columns: str):
    return lambda spark, sf: add_calendar_features(no_origin(spark, sf)).groupBy("FlightDate", *columns).agg(F.count(F.lit(1)).alias("n"))


query("c01_date_parts", with_flights(f"SELECT FlightDate, {DATE_PART_SQL}, count(*) AS n FROM flights_v GROUP BY ALL"))(
    _counted_features("fe_month", "day_of_month", "day_of_week", "fe_quarter", "week_of_year"))
for _number, _flag in enumerate(
    ["is_weekend", "is_new_year", "is_july_4th", "is_christmas", "is_thanksgiving", "is_memorial_day", "is_labor_day",
     "is_major_holiday", "near_new_year", "near_christmas", "near_thanksgiving", "is_holiday_season", "is_summer_travel",
     "is_spring_break_period"], start=2,
):
    query(f"c{_number:02d}_{_flag}", with_flights(f"SELECT FlightDate, {FLAG_SQL[_flag]} AS {_flag}, count(*) AS n FROM flights_v GROUP BY ALL"))(
        _counted_features(_flag))

HOUR = "CRSDepTime // 100"
HOUR_SQL = {
    "dep_hour": HOUR,
    "time_of_day": f"CASE WHEN {HOUR} BETWEEN 6 AND 11 THEN 'morning' WHEN {HOUR} BETWEEN 12 AND 17 THEN 'afternoon' "
    f"WHEN {HOUR} BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END",
    "is_peak_hour": f"CASE WHEN {HOUR} BETWEEN 7 AND 9 OR {HOUR} BETWEEN 17 AND 19 THEN 1 ELSE 0 END",
}
for _number, (_name, _sql) in enumerate(HOUR_SQL.items(), start=16):
    query(f"c{_number}_{_name}", with_flights(f"SELECT CRSDepTime, {_sql} AS {_name}, count(*) AS n FROM flights_v GROUP BY ALL"))(
        lambda spark, sf, name=_name: add_calendar_features(no_origin(spark, sf)).groupBy("CRSDepTime", name).agg(F.count(F.lit(1)).alias("n")))

_TABLE_FLAGS = [
    "is_weekend", "is_major_holiday", "is_new_year", "is_july_4th", "is_christmas", "is_thanksgiving", "is_memorial_day",
    "is_labor_day", "near_new_year", "near_christmas", "near_thanksgiving", "is_holiday_season", "is_summer_travel",
    "is_spring_break_period",
]
query("t13_feature_table", with_flights(
    "SELECT FlightDate, Year, Month, DayofMonth, DayOfWeek, Origin, Dest, Marketing_Airline_Network, Cancelled, Diverted, "
    "CRSDepTime, DepTime, DepDelayMinutes, DepDelay, ArrTime, DepDel15, ArrDel15, Distance, "
    + DATE_PART_SQL + ", " + ", ".join(f"{FLAG_SQL[f]} AS {f}" for f in _TABLE_FLAGS)
    + ", " + ", ".join(f"{sql} AS {name}" for name, sql in HOUR_SQL.items()) + " FROM flights_v"), digits=None)(
    lambda spark, sf: feature_table(views.flights(spark, sf)))

# Holiday tables as SQL over the years of the flights.
YEARS_SQL = "years AS (SELECT CAST(unnest(range(a, b + 1)) AS INTEGER) AS year FROM (SELECT min(Year) AS a, max(Year) AS b FROM flights_v))"
MORE_YEARS_SQL = "more_years AS (SELECT year FROM years UNION SELECT max(year) + 1 FROM years)"


def _nth(month: int, isodow: int, n: int) -> str:
    first = f"make_date(year, {month}, 1)"
    return f"{first} + CAST(({isodow} - isodow({first}) + 7) % 7 + {7 * (n - 1)} AS INTEGER)"


def _last_monday_of_may() -> str:
    return "make_date(year, 5, 31) - CAST(isodow(make_date(year, 5, 31)) - 1 AS INTEGER)"


_FLOATING = {
    "Martin Luther King Jr. Day": _nth(1, 1, 3),
    "Washington''s Birthday": _nth(2, 1, 3),
    "Memorial Day": _last_monday_of_may(),
    "Labor Day": _nth(9, 1, 1),
    "Columbus Day": _nth(10, 1, 2),
    "Thanksgiving Day": _nth(11, 4, 4),
}
_ANCHORED = {
    "New Year''s Day": "make_date(year, 1, 1)",
    "Juneteenth National Independence Day": "CASE WHEN year >= 2021 THEN make_date(year, 6, 19) END",
    "Independence Day": "make_date(year, 7, 4)",
    "Veterans Day": "make_date(year, 11, 11)",
    "Christmas Day": "make_date(year, 12, 25)",
}


def _federal_sql() -> str:
    parts = [f"SELECT {date} AS date, '{name}' AS holiday_name FROM more_years" for name, date in {**_FLOATING, **_ANCHORED}.items()]
    for name, date in _ANCHORED.items():
        parts.append(
            f"SELECT CASE isodow({date}) WHEN 6 THEN {date} - 1 WHEN 7 THEN {date} + 1 END AS date, "
            f"'{name} (observed)' AS holiday_name FROM more_years"
        )
    winter = "('Christmas Day', 'New Year''s Day')"
    summer = "('Memorial Day', 'Independence Day', 'Labor Day')"
    return (
        "federal_raw AS (" + " UNION ALL ".join(parts) + "), federal AS (SELECT date, holiday_name, "
        f"CASE WHEN holiday_name IN {winter} OR holiday_name IN {summer} THEN 1 ELSE 0 END AS is_major_holiday, "
        f"CASE WHEN holiday_name IN {winter} THEN 'Winter Holiday' WHEN holiday_name IN {summer} THEN 'Summer Holiday' ELSE 'Other Holiday' END AS holiday_category, "
        f"CASE WHEN holiday_name IN {winter} THEN 'extreme' WHEN holiday_name IN {summer} THEN 'high' ELSE 'medium' END AS impact_level "
        "FROM federal_raw WHERE date IS NOT NULL AND year(date) IN (SELECT year FROM years))"
    )


FEDERAL_SQL = _federal_sql()
_BREAKS = {
    "Spring Break": ("make_date(year, 3, 11) + CAST(i AS INTEGER)", 10, 0, "School Break", "high"),
    "Summer Vacation Peak": ("make_date(year, 6, 15) + CAST(7 * i AS INTEGER)", 9, 0, "Summer Peak", "medium"),
}
_WEEKS = {
    "Thanksgiving Week": (f"{_nth(11, 4, 4)} + CAST(i AS INTEGER)", "[-3, -2, -1, 1, 2]"),
    "Christmas Week": ("make_date(year, 12, 25) + CAST(i AS INTEGER)", "[-3, -2, -1, 0, 1, 2, 3]"),
}


def _extended_sql() -> str:
    parts = ["SELECT date, holiday_name, is_major_holiday, holiday_category, impact_level FROM federal"]
    for name, (date, count, major, category, impact) in _BREAKS.items():
        parts.append(f"SELECT {date}, '{name}', {major}, '{category}', '{impact}' FROM years, range({count}) t(i)")
    for name, (date, offsets) in _WEEKS.items():
        parts.append(
            f"SELECT * FROM (SELECT {date} AS date, '{name}', 1, 'Winter Holiday', 'extreme' "
            f"FROM years, (SELECT unnest({offsets}) AS i)) WHERE date NOT IN (SELECT date FROM federal)"
        )
    return "extended AS (" + " UNION ALL ".join(parts) + ")"


EXTENDED_SQL = _extended_sql()
DIMENSION_SQL = """days AS (
    SELECT CAST(unnest(generate_series(make_date(min(year), 1, 1)::TIMESTAMP, make_date(max(year), 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date
    FROM years
),
distances AS (
    SELECT date,
           CAST(date IN (SELECT date FROM extended) AS INTEGER) AS is_holiday,
           CAST(date IN (SELECT date FROM extended WHERE is_major_holiday = 1) AS INTEGER) AS is_major_holiday,
           CAST(coalesce((SELECT min(e.date) FROM extended e WHERE e.date > days.date) - date, 999) AS INTEGER) AS days_to_next_holiday,
           CAST(coalesce(date - (SELECT max(e.date) FROM extended e WHERE e.date < days.date), 999) AS INTEGER) AS days_from_prev_holiday
    FROM days
),
dimension AS (
    SELECT *, CAST(days_to_next_holiday BETWEEN 0 AND 7 AS INTEGER) AS is_holiday_week_before,
           CAST(days_from_prev_holiday BETWEEN 0 AND 7 AS INTEGER) AS is_holiday_week_after,
           CAST(days_to_next_holiday BETWEEN 0 AND 3 AS INTEGER) AS is_3days_before_holiday,
           CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend
    FROM distances
)"""
HOLIDAY_VIEWS = (YEARS_SQL, MORE_YEARS_SQL, FEDERAL_SQL, EXTENDED_SQL)


def _years(spark, sf):
    return holidays.years_of(no_origin(spark, sf))


def _with_flight_counts(spark, sf, table):
    """A holiday table of the flights' years with the number of flights on each day."""
    flights = no_origin(spark, sf)
    per_day = flights.groupBy(F.col("FlightDate").alias("date")).agg(F.count(F.lit(1)).alias("flights"))
    return table(holidays.years_of(flights)).join(per_day, "date", "left").fillna(0, ["flights"])


def _flights_per(table, columns, how="inner"):
    """Flights and delay rate per value of columns of a holiday table."""
    def build(spark, sf):
        return delay_rate_by(holidays.join_holidays(no_origin(spark, sf), table(_years(spark, sf)), columns, how), *columns)

    return build


def _on_holidays(source: str, columns: str, where: str = "true", join: str = "JOIN") -> str:
    return with_flights(
        f"SELECT {columns}, {RATE} FROM flights_v {join} {source} h ON FlightDate = h.date AND {where} WHERE NOT Cancelled GROUP BY ALL",
        *HOLIDAY_VIEWS)


query("c19_flights_on_federal_holidays", _on_holidays("federal", "holiday_name"))(
    _flights_per(holidays.federal_holidays, ["holiday_name"]))
query("c19_federal_holidays_of_flight_years", with_flights(
    "SELECT date, holiday_name, is_major_holiday, holiday_category, impact_level, CAST(year(date) AS INTEGER) AS year, "
    "CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, dayname(date) AS day_of_week, "
    "CAST(isodow(date) AS INTEGER) AS day_of_week_num, count(FlightDate) AS flights "
    "FROM federal LEFT JOIN flights_v ON FlightDate = date GROUP BY ALL", *HOLIDAY_VIEWS))(
    lambda spark, sf: _with_flight_counts(spark, sf, holidays.federal_holidays))
query("c20_flights_by_holiday_class", _on_holidays("federal", "is_major_holiday, holiday_category, impact_level"))(
    _flights_per(holidays.federal_holidays, ["is_major_holiday", "holiday_category", "impact_level"]))
for _id, _table, _label in (
    ("c21_flights_in_spring_break", holidays.spring_break, "Spring Break"),
    ("c22_flights_on_summer_peak_days", holidays.summer_peak, "Summer Vacation Peak"),
):
    query(_id, _on_holidays("extended", "holiday_name, impact_level", f"holiday_name = '{_label}'"))(
        _flights_per(_table, ["holiday_name", "impact_level"]))


def _week_without_federal(week):
    return lambda years: holidays.not_on(week(years), holidays.federal_holidays(years))


for _id, _week, _label in (
    ("c23_flights_in_thanksgiving_week", holidays.thanksgiving_week, "Thanksgiving Week"),
    ("c24_flights_in_christmas_week", holidays.christmas_week, "Christmas Week"),
):
    query(_id, _on_holidays("extended", "FlightDate, holiday_name", f"holiday_name = '{_label}'"))(
        lambda spark, sf, week=_week: delay_rate_by(
            holidays.join_holidays(no_origin(spark, sf), _week_without_federal(week)(_years(spark, sf)), ["holiday_name"], "inner"),
            "FlightDate", "holiday_name"))
query("j07_holiday_weeks_without_federal_days", with_flights(
    "SELECT date, holiday_name, count(FlightDate) AS flights FROM extended LEFT JOIN flights_v ON FlightDate = date "
    "WHERE holiday_name IN ('Thanksgiving Week', 'Christmas Week') GROUP BY ALL", *HOLIDAY_VIEWS))(
    lambda spark, sf: _with_flight_counts(spark, sf, lambda years: _week_without_federal(holidays.thanksgiving_week)(years)
    .unionByName(_week_without_federal(holidays.christmas_week)(years))).select("date", "holiday_name", "flights"))
query("u04_extended_holidays_of_flight_years", with_flights(
    "SELECT extended.*, count(FlightDate) AS flights FROM extended LEFT JOIN flights_v ON FlightDate = date GROUP BY ALL", *HOLIDAY_VIEWS))(
    lambda spark, sf: _with_flight_counts(spark, sf, holidays.extended_holidays)
    .select("date", "holiday_name", "is_major_holiday", "holiday_category", "impact_level", "flights"))


def _by_dimension(*columns: str):
    def build(spark, sf):
        flights = no_origin(spark, sf)
        joined = holidays.join_calendar(flights, holidays.date_dimension(holidays.years_of(flights)), list(columns))
        return delay_rate_by(joined, *columns)

    return build


def _dimension_sql(*columns: str) -> str:
    return with_flights(
        f"SELECT {', '.join(columns)}, {RATE} FROM flights_v LEFT JOIN dimension ON FlightDate = date WHERE NOT Cancelled GROUP BY ALL",
        *HOLIDAY_VIEWS, DIMENSION_SQL)


for _id, *_columns in (
    ("c25_rate_by_holiday_day", "is_holiday", "is_major_holiday"),
    ("c26_rate_by_holiday_distance", "days_to_next_holiday", "days_from_prev_holiday"),
    ("c27_rate_by_holiday_week", "is_holiday_week_before", "is_holiday_week_after"),
    ("c28_rate_by_three_days_before", "is_3days_before_holiday"),
    ("c29_rate_by_calendar_weekend", "is_weekend"),
    ("j08_rate_by_days_to_next", "days_to_next_holiday"),
    ("j09_rate_by_days_from_previous", "days_from_prev_holiday"),
):
    query(_id, _dimension_sql(*_columns))(_by_dimension(*_columns))

def _on_calendar(spark, sf, columns):
    flights = no_origin(spark, sf).select("FlightDate")
    return holidays.join_calendar(flights, holidays.date_dimension(holidays.years_of(flights)), columns)


query("w03_holiday_distances_of_flight_years", with_flights(
    "SELECT FlightDate, days_to_next_holiday, days_from_prev_holiday, count(*) AS n FROM flights_v LEFT JOIN dimension ON FlightDate = date "
    "GROUP BY ALL", *HOLIDAY_VIEWS, DIMENSION_SQL))(
    lambda spark, sf: _on_calendar(spark, sf, ["days_to_next_holiday", "days_from_prev_holiday"])
    .groupBy("FlightDate", "days_to_next_holiday", "days_from_prev_holiday").agg(F.count(F.lit(1)).alias("n")))
_DIMENSION_FLAGS = ["is_holiday", "is_major_holiday", "is_holiday_week_before", "is_holiday_week_after", "is_3days_before_holiday", "is_weekend"]
query("a34_flag_totals", with_flights(
    "SELECT " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in _DIMENSION_FLAGS) + " FROM flights_v LEFT JOIN dimension ON FlightDate = date",
    *HOLIDAY_VIEWS, DIMENSION_SQL))(
    lambda spark, sf: flag_totals(_on_calendar(spark, sf, _DIMENSION_FLAGS), _DIMENSION_FLAGS))


@query("j06_flights_on_holidays", with_flights(
    "SELECT CAST(FlightDate IN (SELECT date FROM extended) AS INTEGER) AS on_holiday, count(*) AS n FROM flights_v GROUP BY 1", *HOLIDAY_VIEWS))
def _flagged(spark, sf):
    flights = no_origin(spark, sf)
    days = holidays.extended_holidays(holidays.years_of(flights)).select("date").distinct().withColumn("__hit", F.lit(1))
    flagged = holidays.join_holidays(flights, days, ["__hit"])
    return flagged.groupBy(F.coalesce("__hit", F.lit(0)).alias("on_holiday")).agg(F.count(F.lit(1)).alias("n"))


@query("j15_calendar_join", with_flights(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, FlightDate, is_holiday, days_to_next_holiday, days_from_prev_holiday, is_holiday_week_before "
    "FROM flights_v LEFT JOIN dimension ON FlightDate = date", *HOLIDAY_VIEWS, DIMENSION_SQL))
def _calendar_join(spark, sf):
    flights = no_origin(spark, sf).select(*views.FLIGHT_KEY, "FlightDate")
    columns = ["is_holiday", "days_to_next_holiday", "days_from_prev_holiday", "is_holiday_week_before"]
    return holidays.join_calendar(flights, holidays.date_dimension(holidays.years_of(flights)), columns)


query("w04_nth_weekday", with_flights(
    f"SELECT FlightDate, count(*) AS n FROM flights_v f JOIN (SELECT {_nth(11, 4, 4)} AS t FROM years) ON FlightDate = t GROUP BY 1", YEARS_SQL))(
    lambda spark, sf: no_origin(spark, sf)
    .filter(F.col("FlightDate") == nth_weekday("Year", 11, "THU", 4))
    .groupBy("FlightDate").agg(F.count(F.lit(1)).alias("n")))
