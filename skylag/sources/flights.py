"""Reading flights, yearly parquet or monthly CSV, under one schema."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skylag import fixed_values as fixed
from skylag import schemas
from skylag.operators.filters import completed


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """One or several parquet paths as one table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def read_csv(spark: SparkSession, *paths: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header. Columns are matched to the schema by header name per
    file, so files may order or omit columns differently and none is type-inferred.

    Files are grouped by header; a group is one scan.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(csv_header(spark, path)), []).append(path)
    parts = []
    for header, files in groups.items():
        as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(schemas.conform(spark.read.schema(as_text).option("header", True).csv(files), schema))
    return reduce(DataFrame.unionByName, parts)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder: its first line, read through the file system without a job."""
    place, store = _on_file_system(spark, path)
    if store.getFileStatus(place).isDirectory():
        files = sorted(str(f.getPath()) for f in store.listStatus(place) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(f"no CSV file in {path}")
        place = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = store.open(place)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(store.getConf()).getCodec(place)
    if codec is not None:
        stream = codec.createInputStream(stream)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([(line or "").removeprefix("\ufeff")]), [])


def _on_file_system(spark: SparkSession, path: str):
    """A path and its own file system (local, HDFS, object store)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, store = _on_file_system(spark, path)
    return store.exists(place)


def monthly_paths(folder: str, first: tuple[int, int] = (2018, 1), last: tuple[int, int] = (2022, 7)) -> list[str]:
    """Flights_{year}_{month}.csv from the first to the last (year, month)."""
    months = range(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1])
    return [f"{folder}/Flights_{m // 12}_{m % 12 + 1}.csv" for m in months]


def read_monthly(spark: SparkSession, paths: Sequence[str], required: Sequence[str] = tuple(fixed.CAUSES)) -> DataFrame:
    """Monthly CSV files as raw flights. The first file must have the required columns."""
    absent = [c for c in required if c not in csv_header(spark, paths[0])]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return read_csv(spark, *paths, schema=schemas.RAW_FLIGHTS)


def load_year(spark: SparkSession, folder: str, year: int, schema: T.StructType = schemas.CLEAN_FLIGHTS) -> tuple[DataFrame, list[str]]:
    """Completed flights of one year from its parquet file or else its CSV file, and
    the names of wanted columns the file lacks (they come back as nulls)."""
    parquet, csv = (f"{folder}/Combined_Flights_{year}.{kind}" for kind in ("parquet", "csv"))
    if path_exists(spark, parquet):
        raw = spark.read.parquet(parquet)
        table = schemas.conform(raw, schema)
        header = raw.columns
    elif path_exists(spark, csv):
        header = csv_header(spark, csv)
        table = read_csv(spark, csv, schema=schema)
    else:
        raise FileNotFoundError(f"no flights for {year} in {folder}")
    return completed(table), [f.name for f in schema if f.name not in header]


def load_years(spark: SparkSession, folder: str, years: Sequence[int]) -> DataFrame:
    """Completed flights of several years as one table."""
    return reduce(union_by_name, [load_year(spark, folder, y)[0] for y in years])


def union_by_name(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name, absent ones null."""
    return first.unionByName(second, allowMissingColumns=True)
