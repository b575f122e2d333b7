"""Data-quality checks and column profiles. Each check is one aggregation pass over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.operators.gram import correlations
from wardlake.scale import exact_quantiles, quantiles_of_cells, quartile_brackets, rank_cells

# (table, column, violated when, description)
Rule = tuple[str, str, str, str]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Actual against expected rows per table."""
    parts = [
        tables[name].agg(F.count("*").alias("actual")).select(
            F.lit(name).alias("table_name"), "actual", F.lit(want).cast("bigint").alias("expected")
        )
        for name, want in expected.items()
    ]
    status = F.when(F.col("actual") == F.col("expected"), "OK").otherwise("MISMATCH")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


def col(name: str) -> Column:
    """A column by its exact name, also with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN, where its type has it, as NULL."""
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(col(name)), col(name)) if floating else col(name)


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, missing, n_rows)`` for every column; NaN counts as missing."""
    missing = [F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    records = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), "n_rows") for i, c in enumerate(df.columns)]
    return df.agg(F.count("*").alias("n_rows"), *missing).select(F.inline(F.array(*records)))


def null_pct(df: DataFrame) -> DataFrame:
    """Null percentage of the columns that have NULLs."""
    return null_counts(df).where(F.col("missing") > 0).select("column_name", _pct("missing", "n_rows").alias("null_pct"))


def missing_summary(df: DataFrame, top: int | None = None) -> DataFrame:
    """Missing count and share per column, worst first."""
    found = null_counts(df).where(F.col("missing") > 0)
    out = found.select("column_name", "missing", _pct("missing", "n_rows").alias("missing_pct")).orderBy(
        F.desc("missing"), "column_name"
    )
    return out.limit(top) if top else out


def _pct(part: str, whole: str) -> Column:
    return F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), F.lit(0))


def domain_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Rows breaking each rule; all rules of a table share one pass."""
    parts = []
    for name in dict.fromkeys(rule[0] for rule in rules):
        own = [rule for rule in rules if rule[0] == name]
        wide = tables[name].agg(*[F.count_if(F.expr(rule[2])).alias(f"r{i}") for i, rule in enumerate(own)])
        records = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(rule[1]).alias("column_name"),
                    F.lit(rule[3]).alias("rule"),
                    F.col(f"r{i}").alias("violations"),
                )
                for i, rule in enumerate(own)
            ]
        )
        parts.append(wide.select(F.inline(records)))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("status", F.when(F.col("violations") == 0, "OK").otherwise("VIOLATED"))


def column_quality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing share, distinct values and status per column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[distinct(present(df, c)).alias(f"u{i}") for i, c in enumerate(df.columns)],
    )
    records = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.lit(100.0) * F.col(f"m{i}") / F.nullif(F.col("n"), F.lit(0))).alias("missing_pct"),
                F.col(f"u{i}").alias("distinct_values"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    status = F.when(F.col("missing_pct") > 0, "has missing values").otherwise("ok")
    return wide.select(F.inline(records)).withColumn("status", status)


def outliers_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by more than ``factor`` interquartile ranges, per column, in two scans.

    The brackets of the quartiles also bracket the two bounds, so the scan that finds the exact quartiles keeps the
    values near the bounds too, and what lies beyond them is counted from its result.
    """
    columns = list(columns)
    values = [F.col(c).cast("double") for c in columns]
    numeric = df.select(*[v.alias(f"__v{i}") for i, v in enumerate(values)])
    brackets, head = quartile_brackets(numeric, [f"__v{i}" for i in range(len(columns))], factor)
    cells = rank_cells(numeric, {c: (F.col(f"__v{i}"), [(F.lit(lo), F.lit(hi)) for lo, hi in brackets[i]]) for i, c in enumerate(columns) if brackets[i]})
    quartiles = {r["column"]: r["q"] for r in quantiles_of_cells(cells, [0.25, 0.75]).collect()}  # one row per column
    bounds = {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in quartiles.items()}
    beyond = F.lit(False)
    for i, c in enumerate(columns):
        if c in bounds:
            low, high = bounds[c]
            below = [2 * k for k, (lo, _) in enumerate(brackets[i]) if lo <= low]
            above = [2 * k + 2 for k, (_, hi) in enumerate(brackets[i]) if hi >= high]
            zone, value = F.col("zone"), F.col("value")
            out = zone.isin(below + above) | (value < F.lit(low)) | (value > F.lit(high))
            beyond = F.when(F.col("column") == c, out).otherwise(beyond)
    found = cells.groupBy("column").agg(F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("n"))
    counts = {r["column"]: r["n"] for r in found.collect()}  # one row per column
    rows = [
        (c, counts.get(c, 0), 100.0 * counts.get(c, 0) / n if (n := head[f"n{i}"]) else None, head[f"lo{i}"], head[f"hi{i}"], *bounds.get(c, (None, None)))
        for i, c in enumerate(columns)
    ]
    schema = "column_name string, outliers bigint, outlier_pct double, min_value double, max_value double, lower_bound double, upper_bound double"
    return df.sparkSession.createDataFrame(rows, schema)


def implausible_values(df: DataFrame, limits: Mapping[str, str], list_up_to: int = 10) -> DataFrame:
    """Count of values outside stated limits; the values themselves only when there are few.

    Values are gathered after the count is known, so no task ever holds more than ``list_up_to``.
    """
    names = list(limits)
    wide = df.agg(*[F.count_if(F.expr(condition)).alias(c) for c, condition in limits.items()])
    counts = wide.unpivot([], names, "column_name", "implausible")
    few = counts.where(F.col("implausible").between(1, list_up_to)).select("column_name")
    marked = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.when(F.expr(limits[c]), F.col(c).cast("decimal(18,2)")).alias("hit"))
            for c in names
        ]
    )
    hits = df.select(F.inline(F.filter(marked, lambda m: m.hit.isNotNull())))
    listed = (
        hits.join(few, "column_name", "left_semi")
        .groupBy("column_name")
        .agg(F.array_join(F.array_sort(F.collect_list("hit")).cast("array<string>"), ", ").alias("listed"))
    )
    return counts.join(listed, "column_name", "left").select(
        "column_name", "implausible", F.coalesce("listed", F.lit("")).alias("listed")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    wide = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    records = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"n{i}").alias("n_values"),
                F.col(f"a{i}").cast("double").alias("mean"),
                F.col(f"s{i}").cast("double").alias("std"),
            )
            for i, c in enumerate(columns)
        ]
    )
    five = exact_quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0]).withColumnRenamed("column", "column_name")
    names = ["min_value", "q1", "median", "q3", "max_value"]
    return (
        wide.select(F.inline(records))
        .join(five, "column_name")
        .select("column_name", "n_values", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    )


def dtype_tally(df: DataFrame) -> DataFrame:
    """Row count, column count and columns per type as ``(item, n)``; types come from the schema."""
    tally: dict[str, int] = {}
    for field in df.schema.fields:
        key = f"dtype {field.dataType.simpleString()}"
        tally[key] = tally.get(key, 0) + 1
    records = [F.struct(F.lit("rows").alias("item"), F.col("n"))]
    records += [
        F.struct(F.lit(item).alias("item"), F.lit(n).cast("bigint").alias("n"))
        for item, n in {"columns": len(df.columns), **tally}.items()
    ]
    return df.agg(F.count("*").alias("n")).select(F.inline(F.array(*records)))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bin counts of a numeric column, NULLs left out; empty bins are not listed."""
    value = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("span"))
    spanned = df.where(value.isNotNull()).select(value.alias("v")).withColumn("span", span.scalar())
    lo, hi = F.col("span.lo"), F.col("span.hi")
    bin_no = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * F.lit(bins)))
    )
    return spanned.groupBy(bin_no.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise Pearson correlation of all numeric columns (or those given), as (column_x, column_y, r)."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "column_x string, column_y string, r double")
    return correlations(df, [(c, present(df, c)) for c in columns])


def grouped_quartiles(df: DataFrame, measure: str, groups: Sequence[str] = ()) -> DataFrame:
    """Five-number summary overall or per group."""
    names = ["min_value", "q1", "median", "q3", "max_value"]
    rows = exact_quantiles(df, [measure], [0.0, 0.25, 0.5, 0.75, 1.0], groups)
    return rows.select(*groups, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


# Right-closed severity bands and their names.
SEVERITY_BANDS = [(0, 6, "Low"), (6, 10, "Moderate"), (10, 15, "High"), (15, 25, "Critical")]


def banded_rate(df: DataFrame, score: str, label: str, bands: Sequence[tuple] = SEVERITY_BANDS) -> DataFrame:
    """Mean of a 0/1 label per right-closed band; scores outside every band are left out."""
    band = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        band = F.when((F.col(score) > low) & (F.col(score) <= high), F.lit(name)).otherwise(band)
    return (
        df.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.count(label).alias("n"), (F.lit(100.0) * F.sum(label).cast("double") / F.count(label)).alias("rate_pct"))
    )


