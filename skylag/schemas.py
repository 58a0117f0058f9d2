"""Explicit schemas of the tables, and how a frame is made to fit one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    """'name type, ...' as a schema; needs no running session."""
    pairs = [entry.split() for entry in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and types of the published data sets.
CLEAN_FLIGHTS = _struct(
    "Year int, Month int, DayofMonth int, DayOfWeek int, FlightDate date, "
    "Marketing_Airline_Network string, Operating_Airline string, "
    "OriginAirportID int, Origin string, DestAirportID int, Dest string, "
    "CRSDepTime int, DepTime double, DepDelay double, DepDel15 double, "
    "CRSArrTime int, ArrTime double, ArrDelay double, ArrDel15 double, "
    "Cancelled int, Diverted int, "
    "CarrierDelay double, WeatherDelay double, NASDelay double, SecurityDelay double, LateAircraftDelay double, "
    "Distance double, DistanceGroup int"
)
RAW_FLIGHTS = T.StructType(
    CLEAN_FLIGHTS.fields
    + _struct(
        "DepDelayMinutes double, ArrDelayMinutes double, Quarter int, Tail_Number string, Airline string, "
        "DivAirportLandings double"
    ).fields
)
HOURLY_WEATHER = _struct(
    "time timestamp_ntz, temp double, dwpt double, rhum double, prcp double, snow double, wdir double, "
    "wspd double, wpgt double, pres double, tsun double, coco double"
)
WEATHER = T.StructType(HOURLY_WEATHER.fields + [T.StructField("airport_code", T.StringType())])
FILLED_WEATHER = T.StructType(WEATHER.fields + [T.StructField("data_source", T.StringType())])
AIRPORTS = _struct("airport_code string, airport_name string, latitude double, longitude double, city string, state string")
NEARBY = _struct("missing string, source string")
HOLIDAYS = _struct(
    "date date, holiday_name string, is_major_holiday int, holiday_category string, impact_level string, "
    "year int, month int, day int, day_of_week string, day_of_week_num int"
)


def _typed(df: DataFrame, field: T.StructField):
    column = F.col(f"`{field.name}`")
    source = df.schema[field.name].dataType
    if isinstance(source, (T.DoubleType, T.FloatType)):
        column = F.when(~F.isnan(column), column)
    if source == field.dataType:
        return column.alias(field.name)
    if isinstance(source, T.BooleanType):
        return column.cast(field.dataType).alias(field.name)
    if isinstance(field.dataType, (T.IntegerType, T.LongType)) and isinstance(source, T.StringType):
        column = column.try_cast("double")
    return column.try_cast(field.dataType).alias(field.name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by exact name: absent ones become typed nulls,
    NaN becomes null, text that does not parse becomes null, others are dropped."""
    present = set(df.columns)
    return df.select(
        *[
            _typed(df, f) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def missing_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in columns if c not in present]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself, or an error naming the columns it lacks."""
    absent = missing_columns(df, columns)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def has_columns(df: DataFrame, *columns: str) -> bool:
    return not missing_columns(df, columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def columns_named_like(columns: Iterable[str], keywords: Iterable[str], ignore_case: bool = True) -> list[str]:
    """Column names that contain one of the keywords."""
    def fold(text: str) -> str:
        return text.lower() if ignore_case else text

    words = [fold(k) for k in keywords]
    return [c for c in columns if any(w in fold(c) for w in words)]
