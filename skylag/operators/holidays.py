"""Holiday tables and the daily date dimension, computed by rule from a set of years.

Every function takes a frame with one `year` column, so the calendar can follow
the years found in the flights. All these tables hold at most a few hundred rows
per year; windows over them hold one year, or one row per year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.dates import (
    date_range,
    days_between,
    last_weekday,
    nth_weekday,
    weekday_monday_first,
    weekday_name,
)
from skylag.functions.numeric import indicator
from skylag.session import materialized


def years_between(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("year"))


def years_of(df: DataFrame, date: str = "FlightDate") -> DataFrame:
    """The years that occur among the dates of a table.

    Runs one aggregate over the date column and keeps the years in a small written table,
    so that the many small steps of a calendar need not each look at the table again. A
    lone date far away adds one year, not all years between.
    """
    years = df.select(F.year(date).alias("year")).filter(F.col("year").isNotNull()).distinct()
    return materialized(years, "years")


def _fixed_date(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def _classify(name: Column, fix_names: bool) -> list[Column]:
    """Major flag, category and impact of a holiday name.

    The published lists spell two names differently from the holiday table
    ('Thanksgiving', '(Observed)'), so by default those days count as ordinary.
    With `fix_names` the spelling is aligned first.
    """
    if fix_names:
        name = F.regexp_replace(F.regexp_replace(name, r"^Thanksgiving Day$", "Thanksgiving"), r"\(observed\)", "(Observed)")
    winter, summer = name.isin(fixed.WINTER_HOLIDAYS), name.isin(fixed.SUMMER_HOLIDAYS)
    return [
        indicator(name.isin(fixed.MAJOR_HOLIDAYS)).alias("is_major_holiday"),
        F.when(winter, "Winter Holiday").when(summer, "Summer Holiday").otherwise("Other Holiday").alias("holiday_category"),
        F.when(winter, "extreme").when(summer, "high").otherwise("medium").alias("impact_level"),
    ]


def _date_columns(date: Column) -> list[Column]:
    return [
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        weekday_name(date).alias("day_of_week"),
        weekday_monday_first(date).alias("day_of_week_num"),
    ]


def federal_holidays(years: DataFrame, fix_names: bool = False) -> DataFrame:
    """U.S. federal holidays of the years, by date. A fixed-date holiday on a Saturday is
    also observed on the Friday before, one on a Sunday on the Monday after."""
    return _federal_holidays(years, fix_names).orderBy("date", "holiday_name")


def _federal_holidays(years: DataFrame, fix_names: bool) -> DataFrame:
    year = F.col("year")
    floating = {
        "Martin Luther King Jr. Day": nth_weekday(year, 1, "MON", 3),
        "Washington's Birthday": nth_weekday(year, 2, "MON", 3),
        "Memorial Day": last_weekday(year, 5, "MON"),
        "Labor Day": nth_weekday(year, 9, "MON", 1),
        "Columbus Day": nth_weekday(year, 10, "MON", 2),
        "Thanksgiving Day": nth_weekday(year, 11, "THU", 4),
    }
    anchored = {
        "New Year's Day": _fixed_date(year, 1, 1),
        "Juneteenth National Independence Day": F.when(year >= 2021, _fixed_date(year, 6, 19)),
        "Independence Day": _fixed_date(year, 7, 4),
        "Veterans Day": _fixed_date(year, 11, 11),
        "Christmas Day": _fixed_date(year, 12, 25),
    }

    def entry(name: str, date: Column) -> Column:
        return F.struct(date.alias("date"), F.lit(name).alias("holiday_name"))

    entries = [entry(n, d) for n, d in {**floating, **anchored}.items()]
    for name, date in anchored.items():
        weekday = weekday_monday_first(date)
        observed = F.when(weekday == 6, F.date_sub(date, 1)).when(weekday == 7, F.date_add(date, 1))
        entries.append(entry(f"{name} (observed)", observed))
    # New Year of the year after can be observed on December 31.
    wanted = years.unionByName(years.select((F.col("year") + 1).alias("year"))).distinct()
    rows = wanted.select(F.inline(F.array(*entries))).filter(F.col("date").isNotNull())
    rows = rows.join(years.withColumnRenamed("year", "__year"), F.year("date") == F.col("__year"), "left_semi")
    return rows.select("date", "holiday_name", *_classify(F.col("holiday_name"), fix_names), *_date_columns(F.col("date")))


def _special_days(years: DataFrame, dates: Column, name: str, major: int, category: str, impact: str) -> DataFrame:
    return years.select(F.explode(dates).alias("date")).select(
        "date",
        F.lit(name).alias("holiday_name"),
        F.lit(major).alias("is_major_holiday"),
        F.lit(category).alias("holiday_category"),
        F.lit(impact).alias("impact_level"),
        *_date_columns(F.col("date")),
    )


def _offsets(date: Column, days: list[int]) -> Column:
    return F.array(*[F.date_add(date, d) for d in days])


def spring_break(years: DataFrame) -> DataFrame:
    y = F.col("year")
    return _special_days(years, date_range(_fixed_date(y, 3, 11), _fixed_date(y, 3, 20)), "Spring Break", 0, "School Break", "high")


def summer_peak(years: DataFrame) -> DataFrame:
    y = F.col("year")
    dates = date_range(_fixed_date(y, 6, 15), _fixed_date(y, 8, 15), step_days=7)
    return _special_days(years, dates, "Summer Vacation Peak", 0, "Summer Peak", "medium")


def thanksgiving_week(years: DataFrame) -> DataFrame:
    """Three days before and two after; may still contain federal holidays."""
    dates = _offsets(nth_weekday(F.col("year"), 11, "THU", 4), [-3, -2, -1, 1, 2])
    return _special_days(years, dates, "Thanksgiving Week", 1, "Winter Holiday", "extreme")


def christmas_week(years: DataFrame) -> DataFrame:
    """Three days either side; may still contain federal holidays."""
    dates = _offsets(_fixed_date(F.col("year"), 12, 25), [-3, -2, -1, 0, 1, 2, 3])
    return _special_days(years, dates, "Christmas Week", 1, "Winter Holiday", "extreme")


def not_on(days: DataFrame, taken: DataFrame) -> DataFrame:
    """Days whose date is not taken by the other table."""
    return days.join(taken.select("date").distinct(), "date", "left_anti").select(*days.columns)


def extended_holidays(years: DataFrame, fix_names: bool = False) -> DataFrame:
    """Federal holidays and the school and travel periods, by date; a holiday week skips federal days."""
    return _extended_holidays(years, fix_names).orderBy("date", "holiday_name")


def _extended_holidays(years: DataFrame, fix_names: bool) -> DataFrame:
    federal = _federal_holidays(years, fix_names)
    return (
        federal.unionByName(spring_break(years))
        .unionByName(summer_peak(years))
        .unionByName(not_on(thanksgiving_week(years), federal))
        .unionByName(not_on(christmas_week(years), federal))
    )


def add_holiday_distances(days: DataFrame, date: str = "date", is_holiday: str = "is_holiday") -> DataFrame:
    """Days to the next and from the previous holiday, both strict, 999 where there is none.

    For a table with one row per day; only its rows count. Each window holds one year;
    what lies in other years comes from a table with one row per year.
    """
    holiday = F.when(F.col(is_holiday) == 1, F.col(date))
    dated = days.withColumn("__year", F.year(date))
    per_year = dated.groupBy("__year").agg(F.min(holiday).alias("first"), F.max(holiday).alias("last"))
    years = Window.orderBy("__year")
    around = per_year.select(
        "__year",
        F.min("first").over(years.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
        F.max("last").over(years.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"),
    )
    order = Window.partitionBy("__year").orderBy(date)
    following = F.coalesce(F.min(holiday).over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("__later"))
    preceding = F.coalesce(F.max(holiday).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__earlier"))
    return dated.join(around, "__year").withColumns(
        {
            "days_to_next_holiday": F.coalesce(days_between(following, date), F.lit(fixed.NO_HOLIDAY)),
            "days_from_prev_holiday": F.coalesce(days_between(date, preceding), F.lit(fixed.NO_HOLIDAY)),
        }
    ).drop("__year", "__later", "__earlier")


def calendar_days(years: DataFrame) -> DataFrame:
    """One row per day of the years."""
    y = F.col("year")
    days = years.select(F.explode(date_range(_fixed_date(y, 1, 1), _fixed_date(y, 12, 31))).alias("date"))
    return days.select("date", *_date_columns(F.col("date")))


def date_dimension(years: DataFrame, fix_names: bool = False) -> DataFrame:
    """The daily calendar with holiday flags and distances, written once: joins see its real size."""
    holidays = _extended_holidays(years, fix_names)
    marks = holidays.groupBy("date").agg(F.max("is_major_holiday").alias("is_major_holiday")).withColumn("is_holiday", F.lit(1))
    days = calendar_days(years).join(marks, "date", "left").withColumns(
        {
            "is_holiday": F.coalesce("is_holiday", F.lit(0)),
            "is_major_holiday": F.coalesce("is_major_holiday", F.lit(0)),
        }
    )
    to_next, from_prev = F.col("days_to_next_holiday"), F.col("days_from_prev_holiday")
    dimension = (
        add_holiday_distances(days)
        .withColumns(
            {
                "is_holiday_week_before": indicator(to_next.between(0, 7)),
                "is_holiday_week_after": indicator(from_prev.between(0, 7)),
                "is_3days_before_holiday": indicator(to_next.between(0, 3)),
                "is_weekend": indicator(F.col("day_of_week_num") >= 6),
            }
        )
        .select(
            "date", "year", "month", "day", "day_of_week", "day_of_week_num", "is_holiday", "is_major_holiday",
            "days_to_next_holiday", "days_from_prev_holiday", "is_holiday_week_before", "is_holiday_week_after",
            "is_3days_before_holiday", "is_weekend",
        )
    )
    return materialized(dimension, "calendar")


def join_calendar(flights: DataFrame, dimension: DataFrame, columns: list[str], date: str = "FlightDate") -> DataFrame:
    """Flights with the chosen columns of the date dimension.

    One row per day (366 for each year that occurs). The dimension is a written table, so
    Spark checks its size: below the broadcast threshold the flights are not shuffled.
    """
    days = dimension.select(F.col("date").alias("__date"), *columns)
    return flights.join(days, F.col(date) == F.col("__date"), "left").drop("__date")


def join_holidays(flights: DataFrame, holidays: DataFrame, columns: list[str], how: str = "left", date: str = "FlightDate") -> DataFrame:
    """Flights with the holiday table; a date with two holidays gives two rows.

    The table is written first, so that its real size decides how it is joined.
    """
    days = materialized(holidays.select(F.col("date").alias("__date"), *columns), "holidays")
    return flights.join(days, F.col(date) == F.col("__date"), how).drop("__date")
