"""Registered queries: monthly series, forecasts and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.clinical import with_ctes
from wardlake.operators import series as ops
from wardlake.operators import uploads
from wardlake.plans.registry import query
from wardlake.plans.tables import upload_of

SINCE = "1996-01-01"
LAST = "2001-08-15"  # as-of date: its month is left out
ALPHA, BETA = 0.5, 0.1

SQL_MONTHLY = f"""monthly AS (SELECT encounterclass AS key, date_trunc('month', start)::TIMESTAMP AS month, count(*) AS y
    FROM encounters WHERE start >= TIMESTAMP '{SINCE}' AND date_trunc('month', start) <> date_trunc('month', TIMESTAMP '{LAST}')
    GROUP BY 1, 2)"""
SQL_FILLED = """filled AS (SELECT s.key, s.month, coalesce(m.y, 0) AS y FROM
    (SELECT key, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM
        (SELECT key, min(month) AS lo, max(month) AS hi FROM monthly GROUP BY key)) s
    LEFT JOIN monthly m ON m.key = s.key AND m.month = s.month)"""
SQL_HOLT = f"""pts AS (SELECT key, month, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY key ORDER BY month) AS t FROM filled),
    run AS (SELECT a.key, 1::BIGINT AS t, a.y AS level, b.y - a.y AS trend FROM pts a JOIN pts b ON a.key = b.key AND a.t = 1 AND b.t = 2
        UNION ALL
        SELECT p.key, p.t, {ALPHA}::DOUBLE * p.y + (1 - {ALPHA}::DOUBLE) * (r.level + r.trend),
            {BETA}::DOUBLE * ({ALPHA}::DOUBLE * p.y + (1 - {ALPHA}::DOUBLE) * (r.level + r.trend) - r.level) + (1 - {BETA}::DOUBLE) * r.trend
        FROM run r JOIN pts p ON p.key = r.key AND p.t = r.t + 1),
    done AS (SELECT run.*, last.month AS last_month, last.y AS last_actual FROM run
        JOIN (SELECT key, max(t) AS n FROM pts GROUP BY key) e ON e.key = run.key AND e.n = run.t
        JOIN pts last ON last.key = run.key AND last.t = run.t),
    forecasts AS (SELECT key, last_month + to_months(CAST(h AS INTEGER)) AS month,
        CAST(round_even(level + h * trend, 0) AS BIGINT) AS forecast, last_actual FROM done, generate_series(1, 6) g(h))"""


def monthly_of(spark, d):
    return ops.monthly_series(C.encounters(spark, d), "start", LAST, SINCE, "encounterclass")


def filled_of(spark, d):
    return ops.fill_months(monthly_of(spark, d))


@query("monthly_series", with_ctes("encounters", f"WITH {SQL_MONTHLY} SELECT * FROM monthly"))
def monthly_series(spark, d):
    return monthly_of(spark, d)


@query("monthly_series_filled", with_ctes("encounters", f"WITH {SQL_MONTHLY}, {SQL_FILLED} SELECT * FROM filled"))
def monthly_series_filled(spark, d):
    return filled_of(spark, d)


@query("holt_forecast")
def holt_forecast(spark, d):
    return ops.holt_forecast(filled_of(spark, d), 6)


@query(
    "holt_fixed_forecast",
    with_ctes("encounters", f"WITH RECURSIVE {SQL_MONTHLY}, {SQL_FILLED}, {SQL_HOLT} SELECT key, month, forecast FROM forecasts"),
)
def holt_fixed_forecast(spark, d):
    """The trend for given smoothing parameters."""
    return ops.extrapolate(ops.holt_fixed(filled_of(spark, d), ALPHA, BETA), 6)


@query("holt_winters_forecast")
def holt_winters_forecast(spark, d):
    return ops.holt_winters_forecast(filled_of(spark, d), 6)


@query("forecast_fit_quality")
def forecast_fit_quality(spark, d):
    return ops.fit_quality(filled_of(spark, d))


@query("forecast_backtest")
def forecast_backtest(spark, d):
    return ops.backtest(filled_of(spark, d), 6)


@query(
    "error_metrics",
    with_ctes(
        "encounters",
        f"""WITH {SQL_MONTHLY}, {SQL_FILLED},
        c AS (SELECT key, y AS actual, lag(y) OVER (PARTITION BY key ORDER BY month) AS forecast FROM filled)
        SELECT key, CAST(sum(CAST(abs(forecast - actual) AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS mae,
            sqrt(CAST(sum(CAST((forecast - actual) * (forecast - actual) AS DECIMAL(28,10))) AS DOUBLE) / count(*)) AS rmse,
            CAST(sum(CAST(abs(CAST(forecast - actual AS DOUBLE) / nullif(actual, 0)) AS DECIMAL(28,10))) AS DOUBLE)
                / count(nullif(actual, 0)) * 100 AS mape
        FROM c WHERE forecast IS NOT NULL GROUP BY key""",
    ),
)
def error_metrics(spark, d):
    last_month = F.lag("y").over(Window.partitionBy("key").orderBy("month"))
    naive = filled_of(spark, d).select("key", F.col("y").alias("actual"), last_month.alias("forecast"))
    return ops.error_metrics(naive.where(F.col("forecast").isNotNull()))


@query("capacity_plan")
def capacity_plan(spark, d):
    filled = filled_of(spark, d)
    return ops.capacity_plan(filled, ops.holt_forecast(filled, 6))


@query(
    "capacity_plan_fixed",
    with_ctes(
        "encounters",
        f"""WITH RECURSIVE {SQL_MONTHLY}, {SQL_FILLED}, {SQL_HOLT},
        p AS (SELECT *, CAST(round_even(forecast * 0.008::DOUBLE, 0) AS BIGINT) AS inpatient_cases FROM forecasts),
        n AS (SELECT *, CAST(round_even(inpatient_cases * 4.9::DOUBLE / 30 / 4, 0) AS BIGINT) AS nurses FROM p)
        SELECT key, month, forecast, CAST(forecast - last_actual AS DOUBLE) / last_actual * 100 AS change_pct, inpatient_cases,
            CASE WHEN inpatient_cases > 0 AND nurses < 1 THEN 1 ELSE nurses END AS nurse_shifts FROM n""",
    ),
)
def capacity_plan_fixed(spark, d):
    """The plan on the trend for given smoothing parameters."""
    filled = filled_of(spark, d)
    return ops.capacity_plan(filled, ops.extrapolate(ops.holt_fixed(filled, ALPHA, BETA), 6))


@query("capacity_plan_seasonal")
def capacity_plan_seasonal(spark, d):
    """The plan on the fitted seasonal forecast; series too short for it are left out of the plan."""
    filled = filled_of(spark, d)
    ahead = ops.holt_winters_forecast(filled, 6).where(F.col("error").isNull()).drop("error")
    return ops.capacity_plan(filled, ahead)


@query("upload_forecast")
def upload_forecast(spark, d):
    """From an upload alone: find its date column, count months, fill gaps, fit the trend, look six months ahead."""
    table = upload_of(spark, d)
    found = uploads.detect_date_column(table).first()  # one row
    monthly = uploads.monthly_volume(table, found["column_name"])
    series = monthly.select(F.lit("all").alias("key"), "month", F.col("encounters").alias("y"))
    return ops.holt_forecast(ops.fill_months(series), 6)
