"""Small dimension tables: literal ones and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skylag import fixed_values as fixed
from skylag import schemas


def airports(spark: SparkSession) -> DataFrame:
    """The built-in airport list."""
    return spark.createDataFrame(fixed.AIRPORTS, schemas.AIRPORTS)


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV dimension with a header under an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
