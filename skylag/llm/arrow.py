"""Functions over Arrow batches, with this package found by the Python workers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Spark's own limit is 64 MB: a batch of 10,000 texts is held by the JVM and by the Python worker of every core, and what is worked out from it beside it.
BYTES_PER_TEXT_BATCH = 1 << 20

PACKAGE_FOLDER = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def find_package(df: DataFrame) -> None:
    """Put the folder of this package on the search path of Python workers started from now on."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_FOLDER not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_FOLDER, *filter(None, paths)])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    find_package(df)
    return df.mapInArrow(run, schema)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, for map_batches over whole texts: a batch ends with the row that reaches BYTES_PER_TEXT_BATCH.

    The limit is set for the session and stays, as the plan is run later. One that the application has set itself is left.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if name not in conf.getAll:
        conf.set(name, str(BYTES_PER_TEXT_BATCH))
    return df


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for plans run inside: for rows of some megabytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
