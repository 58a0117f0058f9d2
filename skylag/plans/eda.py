"""The exploratory report from two scans of the flights.

Every breakdown by time is rolled up from one aggregate by year, quarter, month,
weekday and hour, which has at most a few thousand rows per year whatever the
number of flights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.clock import clock_hour
from skylag.functions.numeric import percent, ratio
from skylag.operators import causes, quality, rates

TIME_KEYS = ["Year", "Quarter", "Month", "DayOfWeek"]


def time_base(df: DataFrame) -> DataFrame:
    """Summable counters of all flights per time cell."""
    flown = ~F.col("Cancelled").cast("boolean")
    return df.groupBy(*TIME_KEYS, clock_hour("CRSDepTime").alias("dep_hour")).agg(
        F.count(F.lit(1)).alias("flights"),
        F.count_if(flown).alias("flown"),
        F.sum(F.when(flown, F.col("DepDel15"))).alias("late"),
        F.sum(F.when(flown, F.col("DepDelayMinutes"))).alias("minutes"),
        F.count(F.when(flown, F.col("DepDelayMinutes"))).alias("timed"),
        F.count_if(F.col("Cancelled").cast("boolean")).alias("cancelled"),
        F.count_if(F.col("Diverted").cast("boolean")).alias("diverted"),
    )


def roll_up(base: DataFrame, *keys: Column | str, minutes: bool = False) -> DataFrame:
    """Delay rates per group from the counters; equal to `delay_rate_by` on the flights."""
    flown, late = F.sum("flown"), F.sum("late")
    measures = [
        flown.alias("total_flights"),
        late.cast("double").alias("delayed_flights"),
        percent(late, flown).alias("delay_rate_pct"),
    ]
    if minutes:
        measures.append(ratio(F.sum("minutes"), F.sum("timed")).alias("avg_delay_minutes"))
    return base.groupBy(*keys).agg(*measures).filter(F.col("total_flights") > 0)


def time_reports(base: DataFrame, pivot: int = fixed.PERIOD_PIVOT_YEAR, labels=fixed.PERIOD_LABELS) -> dict[str, DataFrame]:
    """The breakdowns by time; pass a written `time_base` to compute it once."""
    flights = F.sum("flights")
    return {
        "yearly": roll_up(base, "Year", minutes=True),
        "monthly": roll_up(base, "Month"),
        "day_of_week": roll_up(base, "DayOfWeek"),
        "hourly": roll_up(base, "dep_hour"),
        "quarterly": roll_up(base, "Year", "Quarter"),
        "period": roll_up(base, rates.period("Year", pivot, labels).alias("period"), minutes=True),
        "cancellations": base.groupBy("Year").agg(
            flights.alias("total_flights"),
            F.sum("cancelled").alias("cancelled"),
            percent(F.sum("cancelled"), flights).alias("cancel_rate_pct"),
        ),
    }


def place_reports(df: DataFrame, min_airport: int = 10000, min_route: int = 1000, n: int = 20) -> dict[str, DataFrame]:
    """Rankings of airlines, airports and routes."""
    return {
        "airlines": rates.airline_ranking(df, min_airport, n),
        "worst_origins": rates.worst_origins(df, min_airport, n),
        "busiest_origins": rates.busiest_origins(df, n),
        "worst_routes": rates.worst_routes(df, min_route, n),
    }


def cause_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Cause table, yearly minutes, ranking and severity."""
    table = causes.cause_table(df)
    return {
        "causes": table,
        "causes_yearly": causes.cause_millions_by_year(df),
        "cause_ranking": causes.cause_ranking(table),
        "severity": rates.severity_histogram(df),
    }


def quality_reports(df: DataFrame) -> dict[str, DataFrame]:
    profile = quality.null_profile(df, fixed.PROFILED_COLUMNS)
    return {"missing": profile, "completeness": quality.completeness(profile)}
