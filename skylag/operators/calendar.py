"""Calendar features of a flight, each a rule on its date or scheduled clock time.

Output names follow the published feature list except that the derived month and
quarter are called `fe_month` and `fe_quarter`: `month` next to a source column
`Month` cannot be written in Spark's case-insensitive mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.clock import clock_hour
from skylag.functions.dates import weekday_sunday_first
from skylag.functions.numeric import indicator
from skylag.operators.filters import keep_existing

DATE_PARTS = ["fe_month", "day_of_month", "day_of_week", "fe_quarter", "week_of_year"]
DAY_FLAGS = [
    "is_weekend", "is_major_holiday", "is_new_year", "is_july_4th", "is_christmas", "is_thanksgiving",
    "is_memorial_day", "is_labor_day", "near_new_year", "near_christmas", "near_thanksgiving",
    "is_holiday_season", "is_summer_travel", "is_spring_break_period",
]
HOUR_FEATURES = ["dep_hour", "time_of_day", "is_peak_hour"]


def date_parts(date: str = "FlightDate") -> dict[str, Column]:
    d = F.col(date)
    return {
        "fe_month": F.month(d),
        "day_of_month": F.dayofmonth(d),
        "day_of_week": weekday_sunday_first(d),
        "fe_quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
    }


# The rules below read the parts added first, so each part is taken from the date once.
MONTH, DAY, WEEKDAY = "fe_month", "day_of_month", "day_of_week"


def holiday_flags() -> dict[str, Column]:
    """The six holidays with a simple rule."""
    month, day = F.col(MONTH), F.col(DAY)
    monday, thursday = F.col(WEEKDAY) == 2, F.col(WEEKDAY) == 5
    return {
        "is_new_year": indicator((month == 1) & (day == 1)),
        "is_july_4th": indicator((month == 7) & (day == 4)),
        "is_christmas": indicator((month == 12) & (day == 25)),
        "is_thanksgiving": indicator((month == 11) & thursday & day.between(22, 28)),
        "is_memorial_day": indicator((month == 5) & monday & (day >= 25)),
        "is_labor_day": indicator((month == 9) & monday & (day <= 7)),
    }


def travel_period_flags() -> dict[str, Column]:
    """Weekend, days around holidays and the longer travel seasons."""
    month, day = F.col(MONTH), F.col(DAY)
    turn_of_year = (month == 1) & (day <= 2)
    return {
        "is_weekend": indicator(F.col(WEEKDAY).isin(1, 7)),
        "near_new_year": indicator(turn_of_year | ((month == 12) & (day >= 30))),
        "near_christmas": indicator((month == 12) & day.between(23, 26)),
        "near_thanksgiving": indicator((month == 11) & day.between(22, 29)),
        "is_holiday_season": indicator(turn_of_year | (month == 12) | ((month == 11) & (day >= 22))),
        "is_summer_travel": indicator(month.between(6, 8)),
        "is_spring_break_period": indicator(((month == 3) & (day >= 15)) | ((month == 4) & (day <= 10))),
    }


def hour_features() -> dict[str, Column]:
    """Part of the day (unknown and hour 24 count as night) and peak flag."""
    hour = F.col("dep_hour")
    return {
        "time_of_day": F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night"),
        "is_peak_hour": indicator(hour.between(7, 9) | hour.between(17, 19)),
    }


def add_calendar_features(df: DataFrame, date: str = "FlightDate", clock: str = "CRSDepTime") -> DataFrame:
    """All features, without a shuffle; the hour features only where the clock column exists."""
    parts, flags = date_parts(date), {**holiday_flags(), **travel_period_flags()}
    if clock in df.columns:
        parts["dep_hour"] = clock_hour(clock)
        flags |= hour_features()
    major = F.greatest(*holiday_flags())
    return df.withColumns(parts).withColumns(flags).withColumn("is_major_holiday", major)


def feature_table(df: DataFrame) -> DataFrame:
    """The saved feature table: the source columns that exist, then the features."""
    enriched = add_calendar_features(df)
    wanted = fixed.FEATURE_TABLE_COLUMNS + DATE_PARTS + DAY_FLAGS + HOUR_FEATURES
    return keep_existing(enriched, wanted)[0]
