"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the partition coalescing, the skew splitting and the
# switch to a broadcast join after the real size of a side is known. No static
# broadcast threshold above the default is set: the size check decides.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes; wide projections run faster without fusing.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Joins hash on all their keys: sharing a shuffle made on the airport alone would put a hub in one task.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "skylag", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; `master` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by spark.checkpoint.dir.

    Only a local master may fall back to a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="skylag-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits cut their lineage with checkpoint(); give them a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written once below the shared folder and read back.

    For results that several later steps need: they survive lost executors, and what
    led to them is computed once (checkpoint() alone would compute it twice).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
