"""Monthly series, exponential smoothing, error metrics and the capacity plan.

A series is ``(key, month, y)``. It is aggregated to one row per month before anything is gathered,
so the array kept per key grows with the calendar and not with the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.scalars import month_start
from wardlake.operators import smoothing

SEASON = 12
MIN_TREND_MONTHS = 4
# Planning constants (share of inpatient visits, mean stay in days, patients per nurse).
INPATIENT_SHARE = 0.008
MEAN_STAY_DAYS = 4.9
PATIENTS_PER_NURSE = 4


def monthly_series(
    events: DataFrame, at: str, as_of: str, since: str | None = None, key: str | None = None
) -> DataFrame:
    """Rows per month and key since a date, without the unfinished month of ``as_of``. Months without rows are absent."""
    when = F.col(at)
    cut = month_start(F.lit(as_of).cast("timestamp_ntz"))
    kept = events.where(when.isNotNull() & (month_start(when) != cut))
    if since:
        kept = kept.where(when >= F.lit(since).cast("timestamp_ntz"))
    return kept.groupBy((F.col(key) if key else F.lit("all")).alias("key"), month_start(when).alias("month")).agg(
        F.count("*").alias("y")
    )


def fill_months(series: DataFrame) -> DataFrame:
    """Adds the missing months between each key's first and last month as 0."""
    spans = series.groupBy("key").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    calendar = spans.select("key", F.explode(F.expr("sequence(first, last, INTERVAL 1 MONTH)")).alias("month"))
    return calendar.join(series, ["key", "month"], "left").select("key", "month", F.coalesce("y", F.lit(0)).alias("y"))


def as_arrays(series: DataFrame) -> DataFrame:
    """One row per key: ordered values and the last month."""
    ordered = F.array_sort(F.collect_list(F.struct("month", F.col("y").cast("double").alias("y"))))
    return series.groupBy("key").agg(ordered.alias("points")).select(
        "key",
        F.transform("points", lambda p: p.y).alias("ys"),
        F.element_at("points", -1).month.alias("last_month"),
    )


def holt_state(ys: Column, alpha: Column, beta: Column) -> Column:
    """Level, trend and squared one-step errors after running additive-trend smoothing over an array."""
    start = F.struct(
        ys[0].alias("level"), (ys[1] - ys[0]).alias("trend"), F.lit(0.0).alias("sse")
    )

    def step(state: Column, y: Column) -> Column:
        expected = state.level + state.trend
        level = alpha * y + (1 - alpha) * expected
        return F.struct(
            level.alias("level"),
            (beta * (level - state.level) + (1 - beta) * state.trend).alias("trend"),
            (state.sse + (y - expected) * (y - expected)).alias("sse"),
        )

    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), start, step)


def holt_fixed(series: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Smoothing state per key for given parameters; keys with too short a history are left out."""
    arrays = as_arrays(series).where(F.size("ys") >= MIN_TREND_MONTHS)
    a, b = F.lit(float(alpha)), F.lit(float(beta))
    return arrays.select(
        "key", "last_month", a.alias("alpha"), b.alias("beta"), holt_state(F.col("ys"), a, b).alias("state")
    )


def holt_search(series: DataFrame) -> DataFrame:
    """Smoothing state per key with the parameters and start states of least squared error (``smoothing``)."""
    arrays = as_arrays(series).where(F.size("ys") >= MIN_TREND_MONTHS)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [smoothing.fit(ys) for ys in batch["ys"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "last_month": batch["last_month"],
                    "alpha": [f.params[0] for f in fits],
                    "beta": [f.params[1] for f in fits],
                    "level": [f.level for f in fits],
                    "trend": [f.trend for f in fits],
                    "sse": [f.sse for f in fits],
                }
            )

    schema = "key string, last_month timestamp_ntz, alpha double, beta double, level double, trend double, sse double"
    found = arrays.mapInPandas(search, schema)
    return found.select("key", "last_month", "alpha", "beta", F.struct("level", "trend", "sse").alias("state"))


def extrapolate(states: DataFrame, months: int = 6) -> DataFrame:
    """Rounded forecasts for the months after each series ends."""
    steps = states.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months))))
    value = F.col("state.level") + F.col("step") * F.col("state.trend")
    return steps.select(
        "key",
        F.expr("last_month + make_ym_interval(0, step)").alias("month"),
        F.bround(value, 0).cast("bigint").alias("forecast"),
    )


def holt_forecast(series: DataFrame, months: int = 6) -> DataFrame:
    return extrapolate(holt_search(series), months)


# --- additive trend and season -------------------------------------------------------------------


def _seasonal_frame(pdf: pd.DataFrame, months: int) -> pd.DataFrame:
    pdf = pdf.sort_values("month")
    y = pdf["y"].to_numpy(dtype=float)
    key = pdf["key"].iloc[0]
    if len(y) < 2 * SEASON:
        reason = f"series too short for seasonal forecast: {len(y)} months (need >= {2 * SEASON})"
        return pd.DataFrame({"key": [key], "month": [pdf["month"].iloc[-1]], "kind": ["error"], "actual": [np.nan], "value": [np.nan], "error": [reason]})
    model = smoothing.fit(y, SEASON)
    ahead = np.arange(1, months + 1)
    future = model.level + ahead * model.trend + model.season[(len(y) + ahead - 1) % SEASON]
    past = pd.DataFrame({"month": pdf["month"], "kind": "fitted", "actual": y, "value": model.fitted})
    later = pd.DataFrame(
        {
            "month": [pdf["month"].iloc[-1] + pd.DateOffset(months=int(h)) for h in ahead],
            "kind": "forecast",
            "actual": np.nan,
            "value": np.round(future),
        }
    )
    return pd.concat([past, later], ignore_index=True).assign(key=key, error=None)[
        ["key", "month", "kind", "actual", "value", "error"]
    ]


def seasonal_model(series: DataFrame, months: int = 6) -> DataFrame:
    """Fitted and forecast values per key; a key with less than two seasons gets one ``error`` row.

    Each group is one key's monthly series, so its size is bounded by the calendar.
    """
    return series.groupBy("key").applyInPandas(
        lambda pdf: _seasonal_frame(pdf, months),
        "key string, month timestamp_ntz, kind string, actual double, value double, error string",
    )


def holt_winters_forecast(series: DataFrame, months: int = 6) -> DataFrame:
    model = seasonal_model(series, months).where(F.col("kind") != "fitted")
    return model.select("key", "month", F.col("value").cast("bigint").alias("forecast"), "error")


# --- evaluation and planning ---------------------------------------------------------------------


def error_metrics(compared: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """MAE, RMSE and MAPE of ``forecast`` against ``actual``; sums in decimals, so row order does not matter."""
    error = F.col("forecast") - F.col("actual")
    exact = "decimal(28,10)"

    def average(c: Column) -> Column:
        return F.sum(c.cast("double").cast(exact)).cast("double") / F.count(c)

    relative = F.abs(error.cast("double") / F.nullif(F.col("actual").cast("double"), F.lit(0.0)))
    return compared.groupBy(*keys).agg(
        average(F.abs(error)).alias("mae"),
        F.sqrt(average(error * error)).alias("rmse"),
        (average(relative) * 100).alias("mape"),
    )


def fit_quality(series: DataFrame) -> DataFrame:
    """In-sample errors of the seasonal model."""
    fitted = seasonal_model(series, 1).where(F.col("kind") == "fitted")
    return error_metrics(fitted.withColumnRenamed("value", "forecast"))


def backtest(series: DataFrame, test_months: int = 6) -> DataFrame:
    """Hold out the last months, forecast them from the rest with the trend model, compare month by month."""
    from_end = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("month")))
    split = series.withColumn("from_end", from_end)
    train = split.where(F.col("from_end") > test_months).select("key", "month", "y")
    test = split.where(F.col("from_end") <= test_months).select("key", "month", F.col("y").alias("actual"))
    return (
        test.join(holt_forecast(train, test_months), ["key", "month"])
        .withColumn("error", F.col("forecast") - F.col("actual"))
        .select("key", "month", "actual", "forecast", "error")
    )


def capacity_plan(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Change against the last actual month, inpatient cases and nurses per forecast month."""
    last = series.groupBy("key").agg(F.max_by("y", "month").alias("last_actual"))
    cases = F.bround(F.col("forecast") * F.lit(INPATIENT_SHARE), 0).cast("bigint")
    nurses = F.bround(F.col("inpatient_cases") * F.lit(MEAN_STAY_DAYS) / 30 / PATIENTS_PER_NURSE, 0).cast("bigint")
    return (
        forecasts.join(last, "key")
        .withColumn(
            "change_pct", (F.col("forecast") - F.col("last_actual")) / F.nullif(F.col("last_actual"), F.lit(0)) * 100
        )
        .withColumn("inpatient_cases", cases)
        .withColumn("nurses", nurses)
        .withColumn("nurse_shifts", F.when((F.col("inpatient_cases") > 0) & (F.col("nurses") < 1), 1).otherwise(F.col("nurses")).cast("bigint"))
        .select("key", "month", "forecast", "change_pct", "inpatient_cases", "nurse_shifts")
    )
