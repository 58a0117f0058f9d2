"""Previous leg, recent arrivals, scheduled traffic, rolling history."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.catalog import views
from skylag.catalog.calendars import DIMENSION_SQL, HOLIDAY_VIEWS
from skylag.catalog.causes_and_rates import RATE
from skylag.catalog.registry import query
from skylag.catalog.views import FLIGHT_KEY, NEARBY_SQL, WEATHER_SQL, with_flights
from skylag.catalog.weather import FILLED_SQL
from skylag.functions.numeric import ratio
from skylag.models import prep
from skylag.models.evaluate import confusion, count_rows
from skylag.models.train import converged, fit_boosted_trees, fit_logistic, safe_features, score
from skylag.operators import history, propagation
from skylag.operators.sampling import split_by_year
from skylag.operators.weather import nearby_map
from skylag.plans.feature_table import known_only, measures_in, propagation_table, strategic_features
from skylag.session import materialized, scratch_path

no_origin = partial(views.flights, with_origin=False)
KEY = ", ".join(FLIGHT_KEY)

LEGS_SQL = f"""legs AS (
    SELECT *, lag(ArrDelay) OVER (PARTITION BY Tail_Number ORDER BY FlightDate, CRSDepTime, {KEY}) AS prev_arr_delay
    FROM flights_v WHERE NOT Cancelled AND Tail_Number IS NOT NULL
)"""
query("w01_previous_leg", with_flights(f"SELECT {KEY}, Tail_Number, prev_arr_delay FROM legs", LEGS_SQL), digits=None)(
    lambda spark, sf: propagation.previous_leg(no_origin(spark, sf), FLIGHT_KEY).select(*FLIGHT_KEY, "Tail_Number", "prev_arr_delay"))
query("w01_previous_leg_unknown_tails_kept", with_flights(
    f"SELECT {KEY}, lag(ArrDelay) OVER (PARTITION BY Tail_Number ORDER BY FlightDate, CRSDepTime, {KEY}) AS prev_arr_delay "
    "FROM flights_v WHERE NOT Cancelled"), digits=None)(
    lambda spark, sf: propagation.previous_leg(no_origin(spark, sf), FLIGHT_KEY, drop_unknown_tails=False).select(*FLIGHT_KEY, "prev_arr_delay"))
query("a14_propagation_rates", with_flights(
    f"SELECT prev_arr_delay > 15 AS prev_delayed, {RATE} FROM legs WHERE prev_arr_delay IS NOT NULL GROUP BY 1", LEGS_SQL))(
    lambda spark, sf: propagation.propagation_rates(propagation.previous_leg(no_origin(spark, sf), FLIGHT_KEY)))

TIMED_SQL = """timed AS (
    SELECT *, CAST(date_diff('day', DATE '1970-01-01', FlightDate) AS BIGINT) * 1440
              + (CAST(DepTime AS BIGINT) // 100) * 60 + CAST(DepTime AS BIGINT) % 100 AS dep_t,
           CAST(date_diff('day', DATE '1970-01-01', FlightDate) AS BIGINT) * 1440
              + (CAST(ArrTime AS BIGINT) // 100) * 60 + CAST(ArrTime AS BIGINT) % 100 AS arr_t
    FROM flights_v
),
arrivals AS (
    SELECT Year AS y, Dest AS a, arr_t AS t, count(*) AS n, sum(coalesce(ArrDel15, 0)) AS late, sum(coalesce(ArrDelay, 0)) AS delay
    FROM timed WHERE arr_t IS NOT NULL GROUP BY 1, 2, 3
),
departures AS (SELECT DISTINCT Year AS y, Origin AS a, dep_t AS t FROM timed WHERE dep_t IS NOT NULL),
recent AS (
    SELECT d.y, d.a, d.t, sum(r.n) AS n, sum(r.late) AS late, sum(r.delay) AS delay
    FROM departures d JOIN arrivals r ON r.y = d.y AND r.a = d.a AND r.t >= d.t - 120 AND r.t < d.t GROUP BY ALL
)"""
RECENT_COLUMNS = (
    "round(coalesce(late / n, 0), 6) AS origin_delay_rate_past2h, round(coalesce(delay / n, 0), 6) AS origin_arr_delay_avg_past2h, "
    "CAST(coalesce(late, 0) AS DOUBLE) AS origin_late_arrivals_past2h"
)
query("j03_w02_recent_arrivals", with_flights(
    f"SELECT {KEY}, {RECENT_COLUMNS} FROM timed LEFT JOIN recent ON y = Year AND a = Origin AND t = dep_t", TIMED_SQL))(
    lambda spark, sf: propagation.add_recent_arrival_features(views.flights(spark, sf)).select(
        *FLIGHT_KEY, "origin_delay_rate_past2h", "origin_arr_delay_avg_past2h", "origin_late_arrivals_past2h"))
query("o10_airport_minutes_in_window", with_flights(
    "SELECT a AS airport, count(*) AS minutes, CAST(sum(n) AS BIGINT) AS arrivals, CAST(sum(late) AS BIGINT) AS late FROM recent GROUP BY 1", TIMED_SQL))(
    lambda spark, sf: propagation.recent_arrivals(propagation.add_timestamps(views.flights(spark, sf)))
    .filter("recent_arrivals > 0").groupBy("airport")
    .agg(F.count(F.lit(1)).alias("minutes"), F.sum("recent_arrivals").alias("arrivals"), F.sum("recent_late").alias("late")))
query("f03_departure_and_arrival_timestamps", with_flights(
    f"SELECT {KEY}, CAST(dep_t AS DOUBLE) AS DepTimestamp, CAST(arr_t AS DOUBLE) AS ArrTimestamp FROM timed", TIMED_SQL))(
    lambda spark, sf: propagation.add_timestamps(no_origin(spark, sf)).select(*FLIGHT_KEY, "DepTimestamp", "ArrTimestamp"))

TRAFFIC_SQL = """traffic AS (
    SELECT airport, date, hour, CAST(sum(d) AS BIGINT) AS sched_departures, CAST(sum(a) AS BIGINT) AS sched_arrivals FROM (
        SELECT Origin AS airport, FlightDate AS date, CRSDepTime // 100 AS hour, 1 AS d, 0 AS a FROM flights_v
        UNION ALL SELECT Dest, FlightDate, CRSArrTime // 100, 0, 1 FROM flights_v) GROUP BY ALL
)"""
query("w07_scheduled_traffic", with_flights("SELECT * FROM traffic", TRAFFIC_SQL))(
    lambda spark, sf: history.scheduled_traffic(views.flights(spark, sf)))
query("w07_congestion_features", with_flights(
    f"SELECT {KEY}, sched_departures AS origin_sched_departures, sched_arrivals AS origin_sched_arrivals "
    "FROM flights_v LEFT JOIN traffic ON Origin = airport AND FlightDate = date AND CRSDepTime // 100 = hour", TRAFFIC_SQL))(
    lambda spark, sf: history.add_congestion(views.flights(spark, sf)).select(*FLIGHT_KEY, "origin_sched_departures", "origin_sched_arrivals"))


def _rolling_sql(prefix: str, keys: tuple[str, ...]) -> str:
    names = ", ".join(keys)
    frames = ", ".join(
        f"sum(late) OVER (PARTITION BY {names} ORDER BY FlightDate RANGE BETWEEN INTERVAL {s} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) / "
        f"sum(n) OVER (PARTITION BY {names} ORDER BY FlightDate RANGE BETWEEN INTERVAL {s} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) "
        f"AS {prefix}_delay_rate_{s}d" for s in (7, 30))
    return (
        f"{prefix}_history AS (SELECT {names}, FlightDate, {frames} FROM (SELECT {names}, FlightDate, "
        "CAST(count(*) FILTER (NOT Cancelled) AS DOUBLE) AS n, coalesce(sum(DepDel15) FILTER (NOT Cancelled), 0) AS late "
        f"FROM flights_v GROUP BY {names}, FlightDate))"
    )


HISTORY_COLUMNS = [f"{p}_delay_rate_{s}d" for p in history.HISTORY_KEYS for s in (7, 30)]
# 0/0 is null in Spark and not-a-number in the SQL, for days after days with only cancelled flights.
query("w08_rolling_history", with_flights(
    f"SELECT {KEY}, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c}, 6) END AS {c}" for c in HISTORY_COLUMNS)
    + " FROM flights_v f LEFT JOIN origin_history o ON o.Origin = f.Origin AND o.FlightDate = f.FlightDate "
    "LEFT JOIN airline_history a ON a.Marketing_Airline_Network = f.Marketing_Airline_Network AND a.FlightDate = f.FlightDate "
    "LEFT JOIN route_history r ON r.Origin = f.Origin AND r.Dest = f.Dest AND r.FlightDate = f.FlightDate",
    *[_rolling_sql(p, k) for p, k in history.HISTORY_KEYS.items()]))(
    lambda spark, sf: history.add_history(views.flights(spark, sf)).select(*FLIGHT_KEY, *HISTORY_COLUMNS))

LAST_YEAR = "SELECT max(Year) FROM flights_v"


@query("w08_history_of_an_appended_year", with_flights(
    f"SELECT {', '.join('f.' + k for k in FLIGHT_KEY)}, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE round({c}, 6) END AS {c}" for c in HISTORY_COLUMNS)
    + " FROM flights_v f LEFT JOIN origin_history o ON o.Origin = f.Origin AND o.FlightDate = f.FlightDate "
    "LEFT JOIN airline_history a ON a.Marketing_Airline_Network = f.Marketing_Airline_Network AND a.FlightDate = f.FlightDate "
    "LEFT JOIN route_history r ON r.Origin = f.Origin AND r.Dest = f.Dest AND r.FlightDate = f.FlightDate "
    f"WHERE f.Year = ({LAST_YEAR})",
    *[_rolling_sql(p, k) for p, k in history.HISTORY_KEYS.items()]))
def _appended_year(spark, sf):
    """The daily sums of all earlier years are kept; the last year is added to them, and only its own days are worked out."""
    flights = materialized(views.flights(spark, sf), "flights")
    last = flights.agg(F.max("Year")).first()[0]
    kept, new = scratch_path(spark, "daily-sums"), flights.filter(F.col("Year") == last)
    history.keep_daily_sums(flights.filter(F.col("Year") < last), kept)
    history.keep_daily_sums(new, kept)
    return history.add_history_from(new, kept).select(*FLIGHT_KEY, *HISTORY_COLUMNS)


STRATEGIC_COLUMNS = ["days_to_next_holiday", "origin_sched_departures", "route_delay_rate_30d", "temp"]
_JOINED = (
    "FROM flights_v f LEFT JOIN dimension ON f.FlightDate = dimension.date "
    "LEFT JOIN traffic t ON t.airport = f.Origin AND t.date = f.FlightDate AND t.hour = f.CRSDepTime // 100 "
    "LEFT JOIN route_history r ON r.Origin = f.Origin AND r.Dest = f.Dest AND r.FlightDate = f.FlightDate "
    "LEFT JOIN filled w ON w.airport_code = f.Origin AND CAST(w.time AS DATE) = f.FlightDate AND hour(w.time) = f.CRSDepTime // 100"
)


@query("t12_strategic_features_by_year", with_flights(
    "SELECT f.Year, count(*) AS n, count(days_to_next_holiday) AS known_days_to_next_holiday, "
    "count(sched_departures) AS known_origin_sched_departures, "
    "count(CASE WHEN NOT isnan(route_delay_rate_30d) THEN 1 END) AS known_route_delay_rate_30d, count(temp) AS known_temp, "
    "CAST(sum(sched_departures) AS BIGINT) AS departures, round(avg(days_to_next_holiday), 6) AS mean_days_to_next "
    f"{_JOINED} GROUP BY f.Year",
    *HOLIDAY_VIEWS, DIMENSION_SQL, TRAFFIC_SQL, _rolling_sql("route", history.HISTORY_KEYS["route"]), WEATHER_SQL, NEARBY_SQL, FILLED_SQL))
def _strategic(spark, sf):
    """The day-ahead feature table, summed up per year."""
    table = strategic_features(
        views.flights(spark, sf), known_only(views.weather(spark, sf), ["temp"]), nearby_map(spark, views.nearby_pairs()), measures=["temp"], copies="copies")
    days = F.col("days_to_next_holiday")
    return table.groupBy("Year").agg(
        F.sum("copies").alias("n"), *[count_rows(F.col(c).isNotNull(), "copies").alias(f"known_{c}") for c in STRATEGIC_COLUMNS],
        F.sum(F.col("origin_sched_departures") * F.col("copies")).alias("departures"),
        ratio(F.sum(days * F.col("copies")), F.sum(F.when(days.isNotNull(), F.col("copies")))).alias("mean_days_to_next"))


_LABELLED_PARTS = {"Train": "f.Year <= 1998", "Validation": "f.Year = 1999", "Test": "f.Year >= 2000"}


_FEATURE_TABLE_SQL = (*HOLIDAY_VIEWS, DIMENSION_SQL, TRAFFIC_SQL, _rolling_sql("route", history.HISTORY_KEYS["route"]), WEATHER_SQL, NEARBY_SQL, FILLED_SQL)


def _parts_sql(*more: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, count(*) AS rows, count(*) FILTER (DepDel15 = 1) AS positives, count(*) FILTER (DepDel15 = 0) AS negatives, "
        f"count(*) AS scored{''.join(', ' + m for m in more)} {_JOINED} WHERE DepDel15 IS NOT NULL AND {where}" for part, where in _LABELLED_PARTS.items())


def _training_parts(spark, sf):
    """The written feature table by parts, its usable columns, and those that are unbounded text.

    Measures that no training row knows are not joined, and equal rows are written once with the number of their `copies`.
    """
    years = (range(1990, 1999), (1999,), range(2000, 2010))
    flights, weather, mapping = views.flights(spark, sf), views.weather(spark, sf), nearby_map(spark, views.nearby_pairs())
    measures = measures_in(split_by_year(flights, *years).filter("split = 'train'"), weather, mapping)
    table = materialized(strategic_features(flights, weather, mapping, measures=measures, copies="copies"), "strategic")
    parts = split_by_year(table, *years)
    training = parts.filter("split = 'train'").withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    numeric, text = safe_features(table.drop("row_hash", "score", "copies"))
    few, many = prep.split_by_variety(training, [c for c in text if c not in ("split", "Tail_Number")])
    return parts, training, prep.with_known_values(training, numeric), few, [*many, "Tail_Number"]


def _per_part(parts, model) -> DataFrame:
    """Rows per part as the confusion counts and the scores add them up."""
    rows = []
    for part in _LABELLED_PARTS:
        scored = score(model, parts.filter(F.col("split") == part.lower()))
        known = count_rows(F.col("score").between(0, 1) & F.col("prediction").isin(0.0, 1.0), "copies")
        rows.append(confusion(scored, copies="copies", known=known).select(
            F.lit(part).alias("part"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"),
            (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), F.col("known").alias("scored")))
    return reduce(DataFrame.unionByName, rows)


@query("m09_m16_trained_on_strategic_features", with_flights(_parts_sql("true AS converged"), *_FEATURE_TABLE_SQL))
def _trained(spark, sf):
    """Logistic regression on all usable columns of the day-ahead table, scored on every part; text without a bound is hashed."""
    parts, training, numeric, few, many = _training_parts(spark, sf)
    model = fit_logistic(training, numeric, few, weighting="cost", hashed=many)
    return _per_part(parts, model).withColumn("converged", F.lit(converged(model)))


@query("m10_m17_trees_on_strategic_features", with_flights(_parts_sql(), *_FEATURE_TABLE_SQL))
def _boosted(spark, sf):
    """Boosted trees on all usable columns of the day-ahead table, scored on every part; text without a bound is hashed."""
    parts, training, numeric, few, many = _training_parts(spark, sf)
    return _per_part(parts, fit_boosted_trees(training, numeric, few, hashed=many))


# Flights doubled by several weather rows also arrive twice, as in the published order of steps.
_WEATHERED_SQL = (
    "weathered AS (SELECT f.*, w.temp FROM flights_v f LEFT JOIN filled w ON w.airport_code = f.Origin "
    "AND CAST(w.time AS DATE) = f.FlightDate AND hour(w.time) = f.CRSDepTime // 100)"
)
query("t12_propagation_table_by_month", with_flights(
    "SELECT Year, Month, count(*) AS n, count(temp) AS with_temp, round(avg(coalesce(late / recent.n, 0)), 6) AS mean_rate, "
    "CAST(sum(coalesce(late, 0)) AS DOUBLE) AS late FROM timed LEFT JOIN recent ON y = Year AND a = Origin AND t = dep_t GROUP BY ALL",
    WEATHER_SQL, NEARBY_SQL, FILLED_SQL, _WEATHERED_SQL, TIMED_SQL.replace("FROM flights_v", "FROM weathered")))(
    lambda spark, sf: propagation_table(
        views.flights(spark, sf), known_only(views.weather(spark, sf), ["temp"]), nearby_map(spark, views.nearby_pairs()), ["temp"], "copies"
    ).groupBy("Year", "Month").agg(
        F.sum("copies").alias("n"), count_rows(F.col("temp").isNotNull(), "copies").alias("with_temp"),
        ratio(F.sum(F.col("origin_delay_rate_past2h") * F.col("copies")), F.sum("copies")).alias("mean_rate"),
        F.sum(F.col("origin_late_arrivals_past2h") * F.col("copies")).alias("late")))
