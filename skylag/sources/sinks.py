"""Writing tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, year: str = "Year") -> None:
    """Parquet with one folder per year; rows are rebalanced by year first, so that a year
    has few files and a large one is still written in parallel."""
    df.hint("rebalance", year).write.mode("overwrite").partitionBy(year).parquet(path)


def replace_years(df: DataFrame, path: str, year: str = "Year") -> None:
    """Replace the years that occur in the frame, in a table written by `write_by_year`; all others stay as they are.

    Safe to repeat: a year's folder is exchanged when its new files are complete. Rows without a year replace
    those without a year. An empty frame changes nothing. The frame must not be read from the same table.
    """
    dealt = df.hint("rebalance", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dealt.partitionBy(year).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_counted(df: DataFrame, path: str) -> tuple[int, int]:
    """Write parquet and return rows and columns; the rows are added up from the
    footers of the written files, so nothing is computed twice.

    (An observed write would do it in one pass, but once a session has used an
    Observation, a logistic model fitted in it can no longer be shipped to tasks.)
    """
    write_table(df, path)
    return df.sparkSession.read.parquet(path).count(), len(df.columns)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in the order of the keys across files, sorted in parallel by key range."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one UTF-8 CSV file with a header (no byte-order mark)."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
