"""Delay rates, rankings, causes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag.catalog import views
from skylag.catalog.registry import query
from skylag.catalog.views import with_flights
from skylag.operators import causes, rates
from skylag.operators.calendar import add_calendar_features
from skylag.plans import eda

RATE = "count(*) AS total_flights, sum(DepDel15) AS delayed_flights, round(sum(DepDel15) / count(*) * 100, 6) AS delay_rate_pct"
RATE_AVG = RATE + ", round(avg(DepDelayMinutes), 6) AS avg_delay_minutes"
FLOWN = "FROM flights_v WHERE NOT Cancelled"
PERIODS = ("before 1998", "1998", "after 1998")

no_origin = partial(views.flights, with_origin=False)

query("a01_overall", with_flights(
    f"SELECT {RATE_AVG}, CAST(sum(CAST(Cancelled AS INTEGER)) AS BIGINT) AS cancelled_flights {FLOWN}"
))(lambda spark, sf: rates.overall(no_origin(spark, sf)))

query("a02_by_year", with_flights(f"SELECT Year, {RATE_AVG} {FLOWN} GROUP BY Year"))(
    lambda spark, sf: rates.by_year(no_origin(spark, sf)))
query("a03_by_month", with_flights(f"SELECT Month, {RATE} {FLOWN} GROUP BY Month"))(
    lambda spark, sf: rates.by_month(no_origin(spark, sf)))
query("a04_by_day_of_week", with_flights(f"SELECT DayOfWeek, {RATE} {FLOWN} GROUP BY DayOfWeek"))(
    lambda spark, sf: rates.by_day_of_week(no_origin(spark, sf)))

CAUSE_COLUMNS = list(causes.fixed.CAUSES)
query("a05_cause_totals", with_flights(
    "SELECT count(*) AS delayed_flights, "
    + ", ".join(
        f"sum({c}) AS {c.lower()}_minutes, CAST(sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS {c.lower()}_count"
        for c in CAUSE_COLUMNS
    )
    + " FROM flights_v WHERE DepDel15 = 1 AND NOT Cancelled"
))(lambda spark, sf: causes.cause_totals(no_origin(spark, sf)))

CAUSE_LONG = "cause_long AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS cause, sum({c}) AS total_minutes, CAST(count(*) FILTER ({c} > 0) AS BIGINT) AS flights_affected, "
    "count(*) AS delayed FROM flights_v WHERE DepDel15 = 1 AND NOT Cancelled"
    for c, label in causes.fixed.CAUSES.items()
) + ")"


def _cause_sql(denominator: str) -> str:
    return (
        "cause_table AS (SELECT cause, total_minutes, "
        "CAST(round_even(total_minutes / (SELECT sum(total_minutes) FROM cause_long) * 100, 2) AS DOUBLE) AS pct_minutes, "
        "flights_affected, "
        f"CAST(round_even(flights_affected / CAST({denominator} AS DOUBLE) * 100, 2) AS DOUBLE) AS pct_flights, "
        "CAST(round_even(total_minutes / flights_affected, 2) AS DOUBLE) AS avg_minutes FROM cause_long)"
    )


OF_DELAYED = _cause_sql("delayed")
OF_AFFECTED = _cause_sql("(SELECT sum(flights_affected) FROM cause_long)")
query("a06_cause_table", with_flights("SELECT * FROM cause_table", CAUSE_LONG, OF_DELAYED))(
    lambda spark, sf: causes.cause_table(no_origin(spark, sf)))
query("a06_cause_table_share_of_affected", with_flights("SELECT * FROM cause_table", CAUSE_LONG, OF_AFFECTED))(
    lambda spark, sf: causes.cause_table(no_origin(spark, sf), flights_share_of="affected"))
query("a07_cause_minutes_by_year", with_flights(
    "SELECT Year, " + ", ".join(f"sum({c}) AS {c}" for c in CAUSE_COLUMNS)
    + " FROM flights_v WHERE DepDel15 = 1 AND NOT Cancelled GROUP BY Year"
))(lambda spark, sf: causes.cause_minutes_by_year(no_origin(spark, sf)))
query("a07_cause_millions_by_year", with_flights(
    "SELECT Year, " + ", ".join(
        f"round(sum({c}) / 1000000, 2) AS \"{label.split(' (')[0]}\"" for c, label in causes.fixed.CAUSES.items()
    ) + " FROM flights_v WHERE DepDel15 = 1 AND NOT Cancelled GROUP BY Year"
))(lambda spark, sf: causes.cause_millions_by_year(no_origin(spark, sf)))

query("a08_airline_ranking", with_flights(
    f"SELECT Marketing_Airline_Network, {RATE_AVG} {FLOWN} GROUP BY 1 HAVING count(*) >= 100 "
    "ORDER BY total_flights DESC, Marketing_Airline_Network LIMIT 20"
))(lambda spark, sf: rates.airline_ranking(no_origin(spark, sf), min_flights=100))
query("a09_worst_origins", with_flights(
    f"SELECT Origin, {RATE} {FLOWN} GROUP BY 1 HAVING count(*) >= 100 "
    "ORDER BY sum(DepDel15) / count(*) * 100 DESC, Origin LIMIT 20"
))(lambda spark, sf: rates.worst_origins(views.flights(spark, sf), min_flights=100))
query("a10_busiest_origins", with_flights(
    f"SELECT Origin, {RATE} {FLOWN} GROUP BY 1 ORDER BY total_flights DESC, Origin LIMIT 20"
))(lambda spark, sf: rates.busiest_origins(views.flights(spark, sf)))
query("a11_worst_routes", with_flights(
    f"SELECT Origin || '-' || Dest AS route, {RATE} {FLOWN} GROUP BY 1 HAVING count(*) >= 50 "
    "ORDER BY sum(DepDel15) / count(*) * 100 DESC, route LIMIT 20"
))(lambda spark, sf: rates.worst_routes(views.flights(spark, sf), min_flights=50))
query("a12_by_departure_hour", with_flights(f"SELECT CRSDepTime // 100 AS dep_hour, {RATE} {FLOWN} GROUP BY 1"))(
    lambda spark, sf: rates.by_departure_hour(no_origin(spark, sf)))
query("a13_by_quarter", with_flights(f"SELECT Year, Quarter, {RATE} {FLOWN} GROUP BY 1, 2"))(
    lambda spark, sf: rates.by_quarter(no_origin(spark, sf)))
query("a15_by_period", with_flights(
    "SELECT CASE WHEN Year = 1998 THEN '1998' WHEN Year < 1998 THEN 'before 1998' ELSE 'after 1998' END AS period, "
    f"{RATE_AVG} {FLOWN} GROUP BY 1"
))(lambda spark, sf: rates.by_period(no_origin(spark, sf), 1998, PERIODS))
query("a16_severity_histogram", with_flights(
    """SELECT delay_category, count(*) AS flight_count,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS percentage
FROM (SELECT CASE WHEN DepDelayMinutes BETWEEN 15 AND 30 THEN '15-30分钟'
                  WHEN DepDelayMinutes BETWEEN 31 AND 60 THEN '31-60分钟'
                  WHEN DepDelayMinutes BETWEEN 61 AND 120 THEN '1-2小时'
                  WHEN DepDelayMinutes BETWEEN 121 AND 240 THEN '2-4小时'
                  WHEN DepDelayMinutes > 240 THEN '>4小时' ELSE '其他' END AS delay_category
      FROM flights_v WHERE DepDel15 = 1 AND NOT Cancelled) GROUP BY 1"""
))(lambda spark, sf: rates.severity_histogram(no_origin(spark, sf)))
query("a17_cancellation_rates", with_flights(
    """SELECT count(*) AS total_flights, CAST(sum(CAST(Cancelled AS INTEGER)) AS BIGINT) AS cancelled_flights,
       round(sum(CAST(Cancelled AS INTEGER)) / CAST(count(*) AS DOUBLE) * 100, 6) AS cancellation_rate_pct,
       CAST(sum(CAST(Diverted AS INTEGER)) AS BIGINT) AS diverted_flights,
       round(sum(CAST(Diverted AS INTEGER)) / CAST(count(*) AS DOUBLE) * 100, 6) AS diversion_rate_pct
FROM flights_v"""
))(lambda spark, sf: rates.cancellation_rates(no_origin(spark, sf)))
query("a18_cancellation_by_year", with_flights(
    """SELECT Year, count(*) AS total_flights, CAST(sum(CAST(Cancelled AS INTEGER)) AS BIGINT) AS cancelled,
       round(sum(CAST(Cancelled AS INTEGER)) / CAST(count(*) AS DOUBLE) * 100, 6) AS cancel_rate_pct
FROM flights_v GROUP BY Year"""
))(lambda spark, sf: rates.cancellation_by_year(no_origin(spark, sf)))

# Calendar flags as SQL over flights_v; used here and by the calendar queries.
FLAG_SQL = {
    "is_weekend": "dayofweek(FlightDate) IN (0, 6)",
    "is_new_year": "Month = 1 AND DayofMonth = 1",
    "is_july_4th": "Month = 7 AND DayofMonth = 4",
    "is_christmas": "Month = 12 AND DayofMonth = 25",
    "is_thanksgiving": "Month = 11 AND DayOfWeek = 4 AND DayofMonth BETWEEN 22 AND 28",
    "is_memorial_day": "Month = 5 AND DayOfWeek = 1 AND DayofMonth >= 25",
    "is_labor_day": "Month = 9 AND DayOfWeek = 1 AND DayofMonth <= 7",
    "near_new_year": "(Month = 1 AND DayofMonth <= 2) OR (Month = 12 AND DayofMonth >= 30)",
    "near_christmas": "Month = 12 AND DayofMonth BETWEEN 23 AND 26",
    "near_thanksgiving": "Month = 11 AND DayofMonth BETWEEN 22 AND 29",
    "is_holiday_season": "(Month = 11 AND DayofMonth >= 22) OR Month = 12 OR (Month = 1 AND DayofMonth <= 2)",
    "is_summer_travel": "Month IN (6, 7, 8)",
    "is_spring_break_period": "(Month = 3 AND DayofMonth >= 15) OR (Month = 4 AND DayofMonth <= 10)",
}
FLAG_SQL["is_major_holiday"] = " OR ".join(
    f"({FLAG_SQL[c]})"
    for c in ("is_new_year", "is_july_4th", "is_christmas", "is_thanksgiving", "is_memorial_day", "is_labor_day")
)
FLAG_SQL = {name: f"CASE WHEN {rule} THEN 1 ELSE 0 END" for name, rule in FLAG_SQL.items()}


def _rate_by_feature(feature: str):
    return lambda spark, sf: rates.delay_rate_by(add_calendar_features(no_origin(spark, sf)), feature)


for number, feature in ((22, "is_weekend"), (23, "is_major_holiday"), (24, "is_holiday_season"), (25, "is_summer_travel")):
    query(f"a{number}_rate_by_{feature}", with_flights(f"SELECT {FLAG_SQL[feature]} AS {feature}, {RATE} {FLOWN} GROUP BY 1"))(
        _rate_by_feature(feature))
query("a26_rate_by_day_of_week_sunday_first", with_flights(
    f"SELECT CAST(dayofweek(FlightDate) + 1 AS INTEGER) AS day_of_week, {RATE} {FLOWN} GROUP BY 1"
))(_rate_by_feature("day_of_week"))
query("a27_rate_by_derived_month", with_flights(f"SELECT Month AS fe_month, {RATE} {FLOWN} GROUP BY 1"))(_rate_by_feature("fe_month"))

COUNTED_FLAGS = ["is_weekend", "is_major_holiday", "is_holiday_season", "is_summer_travel", "is_spring_break_period"]
query("a28_flag_counts", with_flights(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, {FLAG_SQL[f]} AS value, count(*) AS count FROM flights_v GROUP BY 2" for f in COUNTED_FLAGS
)))(lambda spark, sf: rates.flag_counts(add_calendar_features(no_origin(spark, sf)), COUNTED_FLAGS))

query("a33_most_frequent_destinations", with_flights(
    "SELECT Dest, count(*) AS count FROM flights_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
))(lambda spark, sf: rates.value_counts(no_origin(spark, sf), "Dest", 10))
query("a36_known_arrivals_by_year", with_flights("SELECT Year, count(ArrTime) AS known FROM flights_v GROUP BY 1"))(
    lambda spark, sf: no_origin(spark, sf).groupBy("Year").agg(F.count("ArrTime").alias("known")))
query("a37_distinct_routes", with_flights("SELECT DISTINCT Origin, Dest FROM flights_v"))(
    lambda spark, sf: rates.distinct_values(views.flights(spark, sf), "Origin", "Dest"))

query("a38_top_causes", with_flights(
    """SELECT CAST(rn AS INTEGER) AS rank, cause, pct_minutes,
       round(sum(pct_minutes) OVER (ORDER BY rn), 6) AS cumulative_pct,
       first_value(cause) OVER (ORDER BY rn) = 'Late Aircraft' AS expected_first
FROM (SELECT *, row_number() OVER (ORDER BY total_minutes DESC, cause) AS rn FROM cause_table) WHERE rn <= 2""",
    CAUSE_LONG, OF_DELAYED,
))(lambda spark, sf: causes.top_causes(causes.cause_table(no_origin(spark, sf)), 2))
query("w06_cause_ranking", with_flights(
    """SELECT CAST(row_number() OVER (ORDER BY total_minutes DESC, cause) AS INTEGER) AS rank,
       cause, pct_minutes, pct_flights FROM cause_table""",
    CAUSE_LONG, OF_DELAYED,
))(lambda spark, sf: causes.cause_ranking(causes.cause_table(no_origin(spark, sf))))


@query("j12_cause_minutes_with_flights", with_flights(
    "SELECT cause, total_minutes, flights_affected, avg_minutes FROM cause_table", CAUSE_LONG, OF_DELAYED))
def _joined_causes(spark, sf):
    table = causes.cause_table(no_origin(spark, sf))
    return causes.join_cause_tables(table.select("cause", "total_minutes"), table.select("cause", "flights_affected"))


query("a39_month_table", with_flights(
    "SELECT strftime(make_date(2000, Month, 1), '%b') AS month_name, "
    f"CAST(round_even(sum(DepDel15) / count(*) * 100, 2) AS DOUBLE) AS delay_rate_pct {FLOWN} GROUP BY Month"
))(lambda spark, sf: rates.month_table(rates.by_month(no_origin(spark, sf))))
query("a39_airport_table", with_flights(
    f"SELECT Origin, count(*) AS total_flights, round(sum(DepDel15) / count(*) * 100, 6) AS delay_rate_pct {FLOWN} "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
))(lambda spark, sf: rates.airport_table(rates.busiest_origins(views.flights(spark, sf))))
query("a39_year_table", with_flights(f"SELECT Year, {RATE} {FLOWN} GROUP BY 1"))(
    lambda spark, sf: rates.year_table(rates.by_year(no_origin(spark, sf))))

query("w05_share_of_flights_by_airline", with_flights(
    """SELECT Marketing_Airline_Network, count(*) AS count,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS pct FROM flights_v GROUP BY 1"""
))(lambda spark, sf: rates.share_of_total(rates.value_counts(no_origin(spark, sf), "Marketing_Airline_Network"), "count", "pct"))

# The same breakdowns rolled up from one shared aggregate.
_REPORT_SQL = {
    "yearly": f"SELECT Year, {RATE_AVG} {FLOWN} GROUP BY 1",
    "monthly": f"SELECT Month, {RATE} {FLOWN} GROUP BY 1",
    "day_of_week": f"SELECT DayOfWeek, {RATE} {FLOWN} GROUP BY 1",
    "hourly": f"SELECT CRSDepTime // 100 AS dep_hour, {RATE} {FLOWN} GROUP BY 1",
    "quarterly": f"SELECT Year, Quarter, {RATE} {FLOWN} GROUP BY 1, 2",
}
for _name, _sql in _REPORT_SQL.items():
    query(f"report_{_name}", with_flights(_sql))(
        lambda spark, sf, name=_name: eda.time_reports(eda.time_base(no_origin(spark, sf)))[name])
