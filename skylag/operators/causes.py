"""Delay causes: minutes, affected flights and their shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.numeric import indicator, percent, ratio
from skylag.operators.filters import delayed


def _present(df: DataFrame, causes: Mapping[str, str]) -> dict[str, str]:
    return {c: label for c, label in causes.items() if c in df.columns}


def cause_totals(df: DataFrame, causes: Mapping[str, str] = fixed.CAUSES) -> DataFrame:
    """One wide row over delayed flights: minutes and affected flights per cause."""
    measures = [F.count(F.lit(1)).alias("delayed_flights")]
    for c in _present(df, causes):
        measures.append(F.sum(c).alias(f"{c.lower()}_minutes"))
        measures.append(F.sum(indicator(F.col(c) > 0)).alias(f"{c.lower()}_count"))
    return delayed(df).agg(*measures)


def cause_table(
    df: DataFrame,
    causes: Mapping[str, str] = fixed.CAUSES,
    flights_share_of: str = "delayed",
    digits: int = 2,
) -> DataFrame:
    """One row per cause: minutes, share of minutes, flights, share of flights,
    minutes per affected flight.

    `flights_share_of` is 'delayed' (share of all delayed flights; may add up to
    more than 100) or 'affected' (share of the affected-flight counts).
    """
    if flights_share_of not in ("delayed", "affected"):
        raise ValueError("flights_share_of must be 'delayed' or 'affected'")
    names = _present(df, causes)
    if not names:
        raise ValueError("no delay cause column present")
    rows = [
        F.struct(
            F.lit(label).alias("cause"),
            F.coalesce(F.col(f"{c.lower()}_minutes"), F.lit(0.0)).alias("total_minutes"),
            F.coalesce(F.col(f"{c.lower()}_count"), F.lit(0)).alias("flights_affected"),
            F.col("delayed_flights").alias("delayed_flights"),
        )
        for c, label in names.items()
    ]
    # The wide aggregate is one row, so the window below holds one row per cause.
    long = cause_totals(df, causes).select(F.inline(F.array(*rows)))
    everything = Window.partitionBy()
    all_minutes = F.sum("total_minutes").over(everything)
    all_affected = F.sum("flights_affected").over(everything)
    flights = F.col("delayed_flights") if flights_share_of == "delayed" else all_affected
    return long.select(
        "cause",
        "total_minutes",
        F.bround(percent(F.col("total_minutes"), all_minutes), digits).alias("pct_minutes"),
        "flights_affected",
        F.bround(percent(F.col("flights_affected"), flights), digits).alias("pct_flights"),
        F.bround(ratio(F.col("total_minutes"), F.col("flights_affected")), digits).alias("avg_minutes"),
    ).orderBy(F.desc("total_minutes"), "cause")


def cause_minutes_by_year(df: DataFrame, causes: Mapping[str, str] = fixed.CAUSES) -> DataFrame:
    return delayed(df).groupBy("Year").agg(*[F.sum(c).alias(c) for c in _present(df, causes)]).orderBy("Year")


def cause_millions_by_year(df: DataFrame, causes: Mapping[str, str] = fixed.CAUSES, digits: int = 2) -> DataFrame:
    """Minutes per year and cause in millions, rounded half up, one column per cause."""
    def millions(name: str) -> Column:
        return F.round(F.sum(name) / 1_000_000, digits)

    short = {c: label.split(" (")[0] for c, label in _present(df, causes).items()}
    return delayed(df).groupBy("Year").agg(*[millions(c).alias(s) for c, s in short.items()]).orderBy("Year")


def cause_ranking(table: DataFrame) -> DataFrame:
    """Rank 1.. by minutes with each cause's own shares beside it."""
    order = Window.orderBy(F.desc("total_minutes"), "cause")
    return table.select(
        F.row_number().over(order).alias("rank"), "cause", "pct_minutes", "pct_flights"
    )


def top_causes(table: DataFrame, n: int = 2, expected_first: str = "Late Aircraft") -> DataFrame:
    """The n leading causes with their running share, and whether the first is the expected one."""
    order = Window.orderBy(F.desc("total_minutes"), "cause")
    ranked = table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select(
        "rank",
        "cause",
        "pct_minutes",
        F.sum("pct_minutes").over(running).alias("cumulative_pct"),
        (F.first("cause").over(running) == expected_first).alias("expected_first"),
    )


def join_cause_tables(minutes: DataFrame, flights: DataFrame) -> DataFrame:
    """Minutes per cause beside flights per cause, matched on the cause."""
    return minutes.join(flights, "cause").withColumn(
        "avg_minutes", F.bround(ratio(F.col("total_minutes"), F.col("flights_affected")), 2)
    )
