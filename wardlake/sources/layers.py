"""Bronze, silver and gold layers under one root, each table replaced in one step (``snapshots``)."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators import gold, typing
from wardlake.sources.readers import CLINICAL_TABLES
from wardlake.sources.snapshots import read_snapshot, write_snapshot


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def load_bronze(df: DataFrame, root: str, name: str) -> None:
    """Replace one bronze table: lower-case headers and a load stamp."""
    stamped = lower_headers(df).withColumn("_loaded_at", F.current_timestamp())
    write_snapshot(stamped, f"{root}/bronze/{name}")


def write_silver(df: DataFrame, root: str, name: str, lookup: str | None = None) -> None:
    """Replace one typed silver table, laid out by ``lookup`` if given; running it again gives the same table."""
    write_snapshot(df, f"{root}/silver/{name}", lookup)


def read_layer(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    return read_snapshot(spark, f"{root}/{layer}/{name}")


def gold_views(silver: Mapping[str, DataFrame], as_of: str, listed: list[str]) -> dict[str, Callable[[], DataFrame]]:
    """Named gold queries over silver tables, built lazily."""
    s = silver
    return {
        "admissions_summary": lambda: gold.admissions_summary(s["encounters"]),
        "outcome_distribution": lambda: gold.outcome_distribution(s["patients"]),
        "comorbidity_prevalence": lambda: gold.comorbidity_prevalence(s["conditions"], s["patients"], listed),
        "cost_by_condition": lambda: gold.cost_by_condition(s["conditions"], s["encounters"]),
        "patient_360": lambda: gold.patient_360(
            s["patients"], s["encounters"], s["conditions"], s["procedures"], as_of
        ),
        "revenue_by_month": lambda: gold.revenue_by_month(s["encounters"]),
    }


def rebuild(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, as_of: str, listed: list[str]
) -> dict[str, DataFrame]:
    """Bronze, then silver, then gold views. Each layer reads the one written before it."""

    def build(name: str) -> None:
        load_bronze(raw[name], root, name)
        write_silver(typing.SILVER[name](read_layer(spark, root, "bronze", name)), root, name)

    # the tables do not depend on each other, so their jobs may overlap
    with ThreadPoolExecutor(max_workers=len(CLINICAL_TABLES)) as pool:
        list(pool.map(inheritable_thread_target(spark)(build), CLINICAL_TABLES))
    silver = {name: read_layer(spark, root, "silver", name) for name in CLINICAL_TABLES}
    views = {name: view() for name, view in gold_views(silver, as_of, listed).items()}
    for name, view in views.items():
        view.createOrReplaceTempView(f"gold_{name}")
    return views
