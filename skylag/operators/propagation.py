"""Delay propagation: the aircraft's previous leg and recent arrivals at the origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.functions.clock import MINUTES_PER_DAY, clock_hour, clock_minutes, epoch_minutes, to_number
from skylag.functions.numeric import ratio_or_zero
from skylag.operators.filters import active
from skylag.operators.ordered import previous_value
from skylag.operators.rates import rate_measures


UNKNOWN_MINUTE = -(10**15)
UNKNOWN_SHARES = 4096


def previous_leg(
    flights: DataFrame,
    tie_break: Sequence[str],
    tail: str = "Tail_Number",
    delay: str = "ArrDelay",
    alias: str = "prev_arr_delay",
    drop_unknown_tails: bool = True,
) -> DataFrame:
    """Active flights with the arrival delay of the same aircraft's flight before.

    Ordered by date, scheduled departure and `tie_break` (a column set that makes
    the order total). Every tail number is cut by month, so that few of its rows carry a value
    over; flights without one, which chain to each other unless they are dropped, are cut by
    date and hour, as their number has no bound.
    """
    rows = active(flights)
    known = F.col(tail).isNotNull()
    if drop_unknown_tails:
        rows = rows.filter(known)
        bucket = {"__period": F.trunc("FlightDate", "month")}
    else:
        bucket = {"__period": F.when(known, F.trunc("FlightDate", "month")).otherwise(F.col("FlightDate")), "__hour": F.when(~known, clock_hour("CRSDepTime"))}
    order = ["FlightDate", "CRSDepTime", *tie_break]
    return previous_value(rows, [tail], bucket, order, delay, alias)


def propagation_rates(with_previous: DataFrame, threshold: float = 15, previous: str = "prev_arr_delay") -> DataFrame:
    """Delay rate after a late and after a punctual previous leg."""
    known = with_previous.filter(F.col(previous).isNotNull())
    return known.groupBy((F.col(previous) > threshold).alias("prev_delayed")).agg(*rate_measures())


def add_timestamps(flights: DataFrame, roll_midnight: bool = False) -> DataFrame:
    """Actual departure and arrival in minutes of the day and minutes since 1970.

    Both use FlightDate, so an arrival after midnight is dated a day early, as
    published; `roll_midnight` moves an arrival earlier than its departure to the next day.
    """
    arrival = epoch_minutes("FlightDate", "ArrTime")
    if roll_midnight:
        late = clock_minutes("ArrTime") < clock_minutes("DepTime")
        arrival = arrival + F.when(late, MINUTES_PER_DAY).otherwise(0)
    return flights.withColumns(
        {
            "DepTime_minutes": clock_minutes("DepTime").cast("double"),
            "ArrTime_minutes": clock_minutes("ArrTime").cast("double"),
            "DepTimestamp": epoch_minutes("FlightDate", "DepTime").cast("double"),
            "ArrTimestamp": arrival.cast("double"),
        }
    )


def _airport_minutes(flights: DataFrame, scope: Sequence[str], copies: str | None = None) -> DataFrame:
    """One row per airport and minute with a departure or an arrival: whether flights
    leave, how many arrive, how many of them late, and their summed delay.

    Summed before the shuffle, so its size is bounded by airports times minutes
    however many flights an airport has. `copies` names a column that says how many equal
    flights a row stands for.
    """
    zero = F.lit(0)
    times = F.lit(1) if copies is None else F.col(copies)
    departure = F.struct(
        F.col("Origin").alias("airport"),
        F.col("DepTimestamp").cast("bigint").alias("minute"),
        F.lit(1).alias("departs"),
        (times * 0).alias("arrives"),
        (times * 0).alias("late"),
        F.lit(0.0).cast("double").alias("delay"),
    )
    arrival = F.struct(
        F.col("Dest").alias("airport"),
        F.col("ArrTimestamp").cast("bigint").alias("minute"),
        zero.alias("departs"),
        times.alias("arrives"),
        (F.coalesce(to_number("ArrDel15").cast("int"), zero) * times).alias("late"),
        (F.coalesce(to_number("ArrDelay"), F.lit(0.0)) * times).alias("delay"),
    )
    events = flights.select(*scope, F.inline(F.array(departure, arrival)))
    return (
        events.filter(F.col("airport").isNotNull() & F.col("minute").isNotNull())
        .groupBy(*scope, "airport", "minute")
        .agg(
            F.max("departs").alias("departs"),
            F.sum("arrives").alias("arrives"),
            F.sum("late").alias("late"),
            F.sum("delay").alias("delay"),
        )
    )


def recent_arrivals(flights: DataFrame, window_minutes: int = 120, scope: Sequence[str] = ("Year",), copies: str | None = None) -> DataFrame:
    """Per airport and departure minute t: arrivals, late arrivals and summed arrival
    delay within [t - window, t). Rows count as often as `copies` says, if it is given.

    An airport is cut into days. Arrivals in the last `window` minutes of a day are
    also handed to the next day, the only other one that can see them, so each
    window holds at most a day and `window` minutes of aggregated rows.
    """
    if not 0 < window_minutes <= MINUTES_PER_DAY:
        raise ValueError("window_minutes must be between 1 and 1440")
    minutes = _airport_minutes(flights, scope, copies)
    day = F.floor(F.col("minute") / MINUTES_PER_DAY).cast("bigint")
    near_midnight = F.pmod(F.col("minute"), F.lit(MINUTES_PER_DAY)) >= MINUTES_PER_DAY - window_minutes
    days = F.when(near_midnight & (F.col("arrives") > 0), F.array(day, day + 1)).otherwise(F.array(day))
    spread = minutes.withColumn("__day", F.explode(days))
    trailing = Window.partitionBy(*scope, "airport", "__day").orderBy("minute").rangeBetween(-window_minutes, -1)
    return (
        spread.withColumns(
            {
                "recent_arrivals": F.coalesce(F.sum("arrives").over(trailing), F.lit(0)),
                "recent_late": F.coalesce(F.sum("late").over(trailing), F.lit(0)),
                "recent_delay": F.coalesce(F.sum("delay").over(trailing), F.lit(0.0)),
            }
        )
        .filter((F.col("departs") == 1) & (F.col("__day") == day))
        .select(*scope, "airport", "minute", "recent_arrivals", "recent_late", "recent_delay")
    )


def add_recent_arrival_features(
    flights: DataFrame,
    window_minutes: int = 120,
    scope: Sequence[str] = ("Year",),
    roll_midnight: bool = False,
    fill_delays: bool = True,
    copies: str | None = None,
) -> DataFrame:
    """Flights with late share, mean delay and number of late arrivals at the origin in
    the `window_minutes` before the actual departure.

    0 where nothing arrived or the departure time is unknown, null where the origin
    is unknown. `scope` limits what a flight can see to its own year by default.
    `fill_delays` also replaces unknown arrival delays by 0 in the output, as the
    published table has them. A row arrives as often as its column `copies` says.
    """
    timed = add_timestamps(flights, roll_midnight)
    recent = recent_arrivals(timed, window_minutes, scope, copies).withColumnsRenamed(
        {c: f"__{c}" for c in [*scope, "airport", "minute"]}
    )
    # Flights without a departure time match nothing; spread over many impossible minutes,
    # those of one airport do not meet in one task.
    spread = UNKNOWN_MINUTE - F.pmod(F.xxhash64("FlightDate", "Dest"), F.lit(UNKNOWN_SHARES))
    minute = F.coalesce(F.col("DepTimestamp").cast("bigint"), spread)
    condition = (F.col("Origin") == F.col("__airport")) & (minute == F.col("__minute"))
    for c in scope:
        condition = condition & (F.col(c) == F.col(f"__{c}"))
    joined = timed.join(recent, condition, "left")

    def known_origin(value: Column) -> Column:
        return F.when(F.col("Origin").isNotNull(), F.coalesce(value, F.lit(0.0)))

    features = {
        "origin_delay_rate_past2h": known_origin(ratio_or_zero(F.col("recent_late"), F.col("recent_arrivals"))),
        "origin_arr_delay_avg_past2h": known_origin(ratio_or_zero(F.col("recent_delay"), F.col("recent_arrivals"))),
        "origin_late_arrivals_past2h": known_origin(F.col("recent_late").cast("double")),
    }
    if fill_delays:
        features["ArrDelay"] = F.coalesce(to_number("ArrDelay"), F.lit(0.0))
        features["ArrDel15"] = F.coalesce(to_number("ArrDel15").cast("int"), F.lit(0))
    return joined.withColumns(features).drop(
        "recent_arrivals", "recent_late", "recent_delay", "__airport", "__minute", *[f"__{c}" for c in scope]
    )
