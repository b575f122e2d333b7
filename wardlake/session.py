"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "wardlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator relies on: UTC, adaptive plans, Arrow. ANSI mode may stay on.

    Cluster sizing (executors, memory, shuffle partitions) belongs to spark-submit; only pass
    ``master`` and overrides for local work.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``. In local mode the warehouse folder will do where that
    is unset; on a cluster a folder of the driver's machine would lose rows without a word, so that is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not local and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(warehouse, "_scratch")


def run_path(spark: SparkSession, name: str) -> str:
    """Path ``name`` in this session's folder under the shared folder, which is deleted when the session's JVM ends."""
    jvm = spark.sparkContext._jvm
    root = os.path.join(shared_dir(spark), "wardlake-" + spark.sparkContext.applicationId)
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return os.path.join(root, name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the session's folder for a table written by a job."""
    return run_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives the loss of executors (unlike a local checkpoint) and lets later jobs start from files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
