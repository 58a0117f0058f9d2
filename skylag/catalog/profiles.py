"""Data-quality profiles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.catalog import views
from skylag.catalog.registry import query
from skylag.catalog.views import with_flights, with_views
from skylag.operators import quality, rates
from skylag.operators.weather import join_weather

no_origin = partial(views.flights, with_origin=False)

PROFILE_SQL = "profile AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS missing_count, "
    f"CAST(round_even((count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100, 2) AS DOUBLE) AS missing_pct FROM flights_v"
    for c in fixed.PROFILED_COLUMNS
) + ")"
query("a19_null_profile", with_flights("SELECT * FROM profile", PROFILE_SQL))(
    lambda spark, sf: quality.null_profile(views.flights(spark, sf), fixed.PROFILED_COLUMNS))
query("a20_value_range", with_flights(
    "SELECT min(Year) AS min_year, max(Year) AS max_year, min(Month) AS min_month, max(Month) AS max_month FROM flights_v"))(
    lambda spark, sf: rates.value_range(no_origin(spark, sf), ["Year", "Month"]))
query("a21_completeness", with_flights("SELECT round(100 - avg(missing_pct), 6) AS completeness_pct FROM profile", PROFILE_SQL))(
    lambda spark, sf: quality.completeness(quality.null_profile(views.flights(spark, sf), fixed.PROFILED_COLUMNS)))
query("a29_target_distribution", with_flights(
    "SELECT DepDel15 AS target, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS pct FROM flights_v GROUP BY 1"))(
    lambda spark, sf: quality.target_distribution(no_origin(spark, sf)))
query("a30_imbalance", with_flights(
    "SELECT neg AS negatives, pos AS positives, round(least(neg, pos) / CAST(greatest(neg, pos) AS DOUBLE), 6) AS imbalance_ratio, "
    "least(neg, pos) / CAST(greatest(neg, pos) AS DOUBLE) < 0.1 AS severely_imbalanced FROM ("
    "SELECT count(*) FILTER (DepDel15 = 0) AS neg, count(*) FILTER (DepDel15 = 1) AS pos FROM flights_v)"))(
    lambda spark, sf: quality.imbalance(no_origin(spark, sf)))

# All numeric columns but the target, as the operator takes them by itself.
CORRELATED = [
    *views.FLIGHT_KEY, "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "CRSDepTime", "CRSArrTime", "DepTime", "ArrTime", "DepDelay", "DepDelayMinutes", "ArrDelay", "ArrDel15",
    "CarrierDelay", "LateAircraftDelay", "NASDelay", "WeatherDelay", "SecurityDelay", "Distance", "row_hash", "score",
]
CORRELATION_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(CASE WHEN NOT isnan(corr({c}, DepDel15)) THEN corr({c}, DepDel15) END, 6) AS correlation "
    f"FROM flights_v WHERE {c} IS NOT NULL AND DepDel15 IS NOT NULL"
    for c in CORRELATED
)
query("a31_correlations", with_flights(CORRELATION_SQL))(
    lambda spark, sf: quality.correlations(no_origin(spark, sf)))
query("a31_strong_correlations", with_flights(f"SELECT * FROM ({CORRELATION_SQL}) WHERE abs(correlation) >= 0.5"))(
    lambda spark, sf: quality.strong_correlations(no_origin(spark, sf), threshold=0.5))

MEDIAN_COLUMNS = ["DepDelay", "ArrDelay", "Distance", "CRSDepTime", "row_hash", "DepTime"]
query("a32_medians", with_flights(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(CAST(median({c}) AS DOUBLE), 6) AS median FROM flights_v" for c in MEDIAN_COLUMNS)))(
    lambda spark, sf: quality.medians(no_origin(spark, sf), MEDIAN_COLUMNS))
query("a35_describe", with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, round(min({c}), 6) AS min, "
        f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max "
        "FROM weather_v" for c in fixed.WEATHER_MEASURES), views.WEATHER_SQL))(
    lambda spark, sf: quality.describe(views.weather(spark, sf), fixed.WEATHER_MEASURES))


def _audit_sql(check: str, keywords) -> str:
    hits = " OR ".join(f"contains(lower(column_name), '{k.lower()}')" for k in keywords)
    return f"SELECT '{check}' AS \"check\", column_name AS column FROM (SELECT unnest(columns) AS column_name FROM named) WHERE {hits}"


NAMED_SQL = "named AS (SELECT array_agg(DISTINCT k) AS columns FROM (SELECT unnest(json_keys(to_json(f))) AS k FROM flights_v f))"
query("q03_health_report", with_flights(
    "SELECT \"check\", \"column\" AS item, CAST(NULL AS DOUBLE) AS value FROM ("
    + _audit_sql("leakage", fixed.LEAKAGE_KEYWORDS) + " UNION ALL " + _audit_sql("time_travel", fixed.TIME_TRAVEL_KEYWORDS) + ") "
    "UNION ALL SELECT 'target_pct', coalesce(CAST(DepDel15 AS VARCHAR), 'null'), round(100 * n / CAST(sum(n) OVER () AS DOUBLE), 6) "
    "FROM (SELECT DepDel15, count(*) AS n FROM flights_v GROUP BY 1) "
    "UNION ALL SELECT 'imbalance_ratio', 'DepDel15', round(least(a, b) / CAST(greatest(a, b) AS DOUBLE), 6) "
    "FROM (SELECT count(*) FILTER (DepDel15 = 0) AS a, count(*) FILTER (DepDel15 = 1) AS b FROM flights_v) "
    f"UNION ALL SELECT 'strong_correlation', \"column\", correlation FROM ({CORRELATION_SQL}) WHERE abs(correlation) >= 0.9", NAMED_SQL))(
    lambda spark, sf: quality.health_report(no_origin(spark, sf)))
query("q04_weather_missing_fractions", with_flights(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(round_even((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 3) AS DOUBLE) AS missing_fraction FROM joined"
        for c in fixed.WEATHER_MEASURES),
    views.WEATHER_SQL,
    "joined AS (SELECT f.*, w.* FROM flights_v f LEFT JOIN weather_v w ON Origin = airport_code "
    "AND FlightDate = CAST(time AS DATE) AND CRSDepTime // 100 = hour(time))"))(
    lambda spark, sf: quality.missing_fractions(join_weather(views.flights(spark, sf), views.weather(spark, sf))))
