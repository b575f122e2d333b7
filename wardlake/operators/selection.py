"""Filters, previews and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn"
) -> DataFrame:
    """First k rows per group. The rank filter is pushed below the shuffle as a group limit,

    so a hot group sends at most k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def best_per_group(df: DataFrame, keys: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Row with the highest metric per group, smallest ``tie`` first."""
    return first_per_group(df, keys, [F.desc(metric), F.col(tie)], 1, rank="__rn").drop("__rn")


def drilldown(profile: DataFrame, k: int = 200) -> DataFrame:
    """Patients with the most encounters and their headline facts."""
    return top(profile, [F.desc("total_encounters"), F.col("patient_id")], k).select(
        "patient_id",
        "total_encounters",
        "distinct_conditions",
        "distinct_procedures",
        "age",
        F.when(F.col("deceased"), "Deceased").otherwise("Alive").alias("status"),
    )


def one_patient(profile: DataFrame, patient_id: object) -> DataFrame:
    """A single patient's row; the equality reaches the scan as a pushed filter."""
    return profile.where(F.col("patient_id") == F.lit(patient_id))


def filter_by_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column, read as text, equals ``value``."""
    return df.where(F.col(column).cast("string") == F.lit(value))


def filter_choices(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """Distinct values offered for a filter, in order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("choice"))
    return top(values.distinct(), [F.col("choice")], limit)


def preview(df: DataFrame, order: Sequence[Column], n: int = 5) -> DataFrame:
    """First n rows with the table's row and column counts."""
    rows = df.agg(F.count("*").alias("n")).scalar()
    return top(df, order, n).withColumn("n_rows", rows).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
