"""Delay rates by group: one scan, partial aggregation before the shuffle.

`delay_rate_pct` is the sum of the late flag over *all* rows of the group, so a
flight with an unknown flag stays in the denominator.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.clock import as_column, clock_hour
from skylag.functions.numeric import percent
from skylag.operators.filters import active, at_least, delayed, top

LABEL = "DepDel15"
MINUTES = "DepDelayMinutes"


def rate_measures(label: str = LABEL, minutes: str | None = None) -> list[Column]:
    """Flights, late flights, late share and, if asked for, mean delay."""
    late = F.sum(F.col(label).cast("double"))
    measures = [
        F.count(F.lit(1)).alias("total_flights"),
        late.alias("delayed_flights"),
        percent(late, F.count(F.lit(1))).alias("delay_rate_pct"),
    ]
    if minutes:
        measures.append(F.avg(minutes).alias("avg_delay_minutes"))
    return measures


def delay_rate_by(df: DataFrame, *keys: Column | str, label: str = LABEL, minutes: str | None = None) -> DataFrame:
    """Delay rate of active flights per group."""
    return active(df).groupBy(*[as_column(k) for k in keys]).agg(*rate_measures(label, minutes))


def overall(df: DataFrame, label: str = LABEL, minutes: str = MINUTES) -> DataFrame:
    """One row over all active flights. `cancelled_flights` is 0 by construction,
    since cancelled flights are removed first; the column is part of the published table."""
    return active(df).agg(*rate_measures(label, minutes), F.sum(F.col("Cancelled").cast("int")).alias("cancelled_flights"))


def by_year(df: DataFrame) -> DataFrame:
    return delay_rate_by(df, "Year", minutes=MINUTES).orderBy("Year")


def by_month(df: DataFrame) -> DataFrame:
    return delay_rate_by(df, "Month").orderBy("Month")


def by_day_of_week(df: DataFrame) -> DataFrame:
    return delay_rate_by(df, "DayOfWeek").orderBy("DayOfWeek")


def by_quarter(df: DataFrame) -> DataFrame:
    return delay_rate_by(df, "Year", "Quarter").orderBy("Year", "Quarter")


def by_departure_hour(df: DataFrame) -> DataFrame:
    return delay_rate_by(df, clock_hour("CRSDepTime").alias("dep_hour")).orderBy("dep_hour")


def airline_ranking(df: DataFrame, min_flights: int = 10000, n: int = 20, key: str = "Marketing_Airline_Network") -> DataFrame:
    """Airlines of a minimum size, largest first."""
    return top(at_least(delay_rate_by(df, key, minutes=MINUTES), "total_flights", min_flights), n, "total_flights", [key])


def worst_origins(df: DataFrame, min_flights: int = 10000, n: int = 20, key: str = "Origin") -> DataFrame:
    return top(at_least(delay_rate_by(df, key), "total_flights", min_flights), n, "delay_rate_pct", [key])


def busiest_origins(df: DataFrame, n: int = 20, key: str = "Origin") -> DataFrame:
    return top(delay_rate_by(df, key), n, "total_flights", [key])


def route(origin: str = "Origin", dest: str = "Dest") -> Column:
    """Origin-Dest, null if either is unknown."""
    return F.concat(F.col(origin), F.lit("-"), F.col(dest))


def worst_routes(df: DataFrame, min_flights: int = 1000, n: int = 20) -> DataFrame:
    rates = delay_rate_by(df, route().alias("route"))
    return top(at_least(rates, "total_flights", min_flights), n, "delay_rate_pct", ["route"])


def period(year: Column | str, pivot: int = fixed.PERIOD_PIVOT_YEAR, labels: Sequence[str] = fixed.PERIOD_LABELS) -> Column:
    before, during, after = labels
    y = as_column(year)
    return F.when(y == pivot, during).when(y < pivot, before).otherwise(after)


def by_period(df: DataFrame, pivot: int = fixed.PERIOD_PIVOT_YEAR, labels: Sequence[str] = fixed.PERIOD_LABELS) -> DataFrame:
    return delay_rate_by(df, period("Year", pivot, labels).alias("period"), minutes=MINUTES)


def share_of_total(df: DataFrame, measure: str, alias: str, within: Iterable[str] = ()) -> DataFrame:
    """Percent of the total of an aggregated measure.

    The total is one row computed from the aggregate and read back as a scalar,
    so no window pulls all groups into one task.
    """
    keys = list(within)
    if keys:
        totals = df.groupBy(*keys).agg(F.sum(measure).alias("__total"))
        return df.join(totals, keys).withColumn(alias, percent(F.col(measure), F.col("__total"))).drop("__total")
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(alias, percent(F.col(measure), total))


def severity(minutes: Column | str = MINUTES) -> Column:
    """Class of a delay; minutes between two classes and null fall into the last label."""
    m = as_column(minutes)
    (low, high, label), *others = fixed.SEVERITY_CLASSES
    branch = F.when(m.between(low, high), label)
    for low, high, label in others:
        branch = branch.when(m.between(low, high), label)
    limit, label = fixed.SEVERITY_ABOVE
    return branch.when(m > limit, label).otherwise(fixed.SEVERITY_OTHER)


def severity_histogram(df: DataFrame) -> DataFrame:
    """Delayed flights per severity class with their percent of all delayed flights."""
    counts = delayed(df).groupBy(severity().alias("delay_category")).agg(F.count(F.lit(1)).alias("flight_count"))
    return share_of_total(counts, "flight_count", "percentage").orderBy(F.desc("flight_count"), "delay_category")


def _flag_sum(name: str) -> Column:
    return F.sum(F.col(name).cast("int"))


def cancellation_rates(df: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_flights"),
        _flag_sum("Cancelled").alias("cancelled_flights"),
        percent(_flag_sum("Cancelled"), total).alias("cancellation_rate_pct"),
        _flag_sum("Diverted").alias("diverted_flights"),
        percent(_flag_sum("Diverted"), total).alias("diversion_rate_pct"),
    )


def cancellation_by_year(df: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return (
        df.groupBy("Year")
        .agg(
            total.alias("total_flights"),
            _flag_sum("Cancelled").alias("cancelled"),
            percent(_flag_sum("Cancelled"), total).alias("cancel_rate_pct"),
        )
        .orderBy("Year")
    )


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows per value of each flag: one scan groups by all flags at once, and the
    few combinations are then unpivoted and added up."""
    combos = df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))
    long = combos.unpivot("n", list(flags), "feature", "value")
    return long.groupBy("feature", "value").agg(F.sum("n").alias("count")).orderBy("feature", "value")


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows per value including null, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts if n is None else top(counts, n, "count", [column])


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def flag_totals(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in flags])


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, in one row."""
    return df.agg(*[f(c).alias(f"{name}_{c.lower()}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def month_table(monthly: DataFrame) -> DataFrame:
    """Month name and rounded rate, from the monthly rates."""
    name = F.date_format(F.make_date(F.lit(2000), F.col("Month"), F.lit(1)), "MMM")
    return monthly.select(name.alias("month_name"), F.bround("delay_rate_pct", 2).alias("delay_rate_pct"))


def airport_table(busiest: DataFrame) -> DataFrame:
    return busiest.select("Origin", "total_flights", "delay_rate_pct")


def year_table(yearly: DataFrame) -> DataFrame:
    return yearly.select("Year", "total_flights", "delayed_flights", "delay_rate_pct")
