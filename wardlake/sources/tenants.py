"""Chunk and vector store, one folder per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions.scalars import safe_id

FOLDERS = ["batch", "tenant_id"]


def with_tenant(chunks: DataFrame, name: str = "source") -> DataFrame:
    return chunks.withColumn("tenant_id", safe_id(F.col(name)))


def append(chunks: DataFrame, path: str, batch: str) -> None:
    """Add one batch of chunk rows. A batch written again replaces itself, so a retried job adds nothing twice.

    Rows are gathered by tenant and evened out by size: a large tenant is written by as many tasks as its bytes need.
    """
    (
        chunks.withColumn("batch", F.lit(batch))
        .hint("rebalance", "tenant_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FOLDERS)
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str, tenant_id: str | None = None) -> DataFrame:
    """Stored rows; a tenant's rows come from its folders only.

    Folder names are text: tenants ``007`` and ``7`` are two tenants.
    """
    found = spark.read.parquet(path)
    folders = [T.StructField(c, T.StringType()) for c in FOLDERS]
    schema = T.StructType([*(f for f in found.schema.fields if f.name not in FOLDERS), *folders])
    stored = spark.read.schema(schema).parquet(path)
    return stored.where(F.col("tenant_id") == tenant_id) if tenant_id is not None else stored


def counts(spark: SparkSession, path: str) -> DataFrame:
    return read_store(spark, path).groupBy("tenant_id").agg(F.count("*").alias("chunks"))


def tenant_list(rows: DataFrame) -> DataFrame:
    """Tenants that have rows, in order."""
    return rows.select("tenant_id").distinct().orderBy("tenant_id")
