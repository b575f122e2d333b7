import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import series as ops
from wardlake.operators import smoothing

SCHEMA = "key string, month timestamp_ntz, y long"


def months(values, key="a", start=(2018, 1)):
    out = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i
        out.append((key, dt.datetime(start[0] + m // 12, m % 12 + 1, 1), v))
    return [r for r in out if r[2] is not None]


def frame(spark, *series):
    return spark.createDataFrame([r for s in series for r in s], SCHEMA)


def holt(y, alpha, beta):
    level, trend, sse = y[0], y[1] - y[0], 0.0
    for value in y[1:]:
        expected = level + trend
        sse += (value - expected) ** 2
        new = alpha * value + (1 - alpha) * expected
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return level, trend, sse


def test_as_of_month_is_left_out_and_gaps_are_filled(spark):
    stamps = ["2020-01-05", "2020-01-31", "2020-04-02", "2020-05-01"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("at"))
    got = ops.monthly_series(df, "at", "2020-05-20")
    assert sorted((r["month"].month, r["y"]) for r in got.collect()) == [(1, 2), (4, 1)]
    filled = ops.fill_months(got)
    assert sorted((r["month"].month, r["y"]) for r in filled.collect()) == [(1, 2), (2, 0), (3, 0), (4, 1)]
    assert ops.monthly_series(df, "at", "2020-05-20", since="2020-02-01").count() == 1


def test_holt_matches_recursion(spark):
    y = [10, 12, 9, 15, 18, 17, 21]
    state = ops.holt_fixed(frame(spark, months(y)), 0.4, 0.3).first()["state"]
    assert (state["level"], state["trend"], state["sse"]) == pytest.approx(holt([float(v) for v in y], 0.4, 0.3), rel=1e-12)


def seasonal(y, alpha, beta, gamma, level, trend, seasons):
    """Squared one-step error of the additive recursion from given start states."""
    seasons, sse = list(seasons), 0.0
    for t, value in enumerate(y):
        held, expected = seasons[t % len(seasons)], level + trend
        sse += (value - expected - held) ** 2
        new = alpha * (value - held) + (1 - alpha) * expected
        seasons[t % len(seasons)] = gamma * (value - expected) + (1 - gamma) * held
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return sse


def test_holt_search_is_never_above_a_grid(spark):
    rng = np.random.default_rng(4)
    shapes = {
        "ragged": [10, 14, 9, 16, 18, 13, 21, 25, 19, 28],
        "walk": np.cumsum(rng.integers(-5, 8, 60)) + 200,
        "noise": rng.integers(50, 90, 40),
        "step": [20] * 15 + [80] * 15,
        "zeros": [0, 0, 3, 0, 0, 0, 9, 0],
        "four": [3, 9, 1, 4],
    }
    df = frame(spark, *[months([int(v) for v in y], key=name) for name, y in shapes.items()])
    got = {r["key"]: r for r in ops.holt_search(df).collect()}
    cells = np.arange(0, 101, 4) / 100
    for name, y in shapes.items():
        best = min(holt([float(v) for v in y], a, b)[2] for a in cells for b in cells)
        assert 0 <= got[name]["alpha"] <= 1 and 0 <= got[name]["beta"] <= 1
        assert got[name]["state"]["sse"] <= best + 1e-6, name


def test_seasonal_fit_is_never_above_a_grid():
    rng = np.random.default_rng(5)
    wave = 100 + 30 * np.sin(2 * np.pi * np.arange(60) / 12)
    shapes = [wave + rng.normal(0, 6, 60), np.cumsum(rng.normal(0, 4, 48)) + wave[:48], rng.integers(0, 9, 30).astype(float)]
    cells = [0.05, 0.2, 0.5, 0.8, 0.95]
    for y in shapes:
        fitted = smoothing.fit(y, 12)
        assert fitted.sse == pytest.approx(((y - fitted.fitted) ** 2).sum(), rel=1e-6)
        years = len(y) // 12
        means = y[: 12 * years].reshape(years, 12).mean(axis=1)
        slope = (means[-1] - means[0]) / (12 * max(1, years - 1))
        base = means[0] - slope * 6.5
        first = (y[: 12 * years] - base - slope * np.arange(1, 12 * years + 1)).reshape(years, 12).mean(axis=0)
        best = min(seasonal(y, a, b, g, base, slope, first) for a in cells for b in cells for g in cells)
        assert fitted.sse <= best + 1e-6


def planted(rng, n, alpha, beta, gamma, season):
    level, trend, seasons, out = 500.0, 1.0, list(40 * np.sin(2 * np.pi * np.arange(season) / max(season, 1))), []
    for t in range(n):
        held = seasons[t % season] if season else 0.0
        value = level + trend + held + rng.normal(0, 5)
        new = alpha * (value - held) + (1 - alpha) * (level + trend)
        if season:
            seasons[t % season] = gamma * (value - level - trend) + (1 - gamma) * held
        trend, level = beta * (new - level) + (1 - beta) * trend, new
        out.append(value)
    return np.array(out)


@pytest.mark.parametrize("alpha, beta, gamma, season", [(0.6, 0.2, 0, 0), (0.3, 0.6, 0, 0), (0.5, 0.1, 0.3, 12), (0.7, 0.05, 0.2, 12)])
def test_planted_parameters_are_found(alpha, beta, gamma, season):
    fitted = smoothing.fit(planted(np.random.default_rng(1), 900, alpha, beta, gamma, season), season)
    want = [alpha, beta, gamma][: len(fitted.params)]
    assert np.abs(fitted.params - want).max() < 0.12
    assert np.sqrt(fitted.sse / 900) == pytest.approx(5, rel=0.08)


def test_minimum_at_a_bound_and_inside():
    inside = smoothing.bounded_minimum(lambda p: ((p - [0.123, 0.77, 0.5]) ** 2 @ [1, 50, 9]) + 1, 3)
    assert np.abs(inside - [0.123, 0.77, 0.5]).max() < 1e-3
    corner = smoothing.bounded_minimum(lambda p: (p - [-0.4, 1.3]) ** 2 @ [1, 2] + p[:, 0] * p[:, 1], 2)
    assert corner.tolist() == [0.0, 1.0]


def test_short_series_and_straight_line(spark):
    df = frame(spark, months([1, 2, 3]), months([10, 20, 30, 40], key="b"))
    got = ops.holt_forecast(df, 3).orderBy("month").collect()
    assert [(r["key"], r["forecast"]) for r in got] == [("b", 50), ("b", 60), ("b", 70)]
    assert got[0]["month"] == dt.datetime(2018, 5, 1)


def test_seasonal_needs_two_years_and_finds_the_season(spark):
    wave = [100 + 2 * i + 30 * np.sin(2 * np.pi * i / 12) for i in range(48)]
    df = frame(spark, months([int(round(v)) for v in wave], key="long"), months([5] * 23, key="short"), months([7] * 24, key="flat"))
    rows = ops.holt_winters_forecast(df, 12).collect()
    short = [r for r in rows if r["key"] == "short"]
    assert len(short) == 1 and "23 months" in short[0]["error"] and short[0]["forecast"] is None
    flat = [r["forecast"] for r in rows if r["key"] == "flat"]
    assert flat == [7] * 12
    ahead = [r["forecast"] for r in sorted((r for r in rows if r["key"] == "long"), key=lambda r: r["month"])]
    truth = [100 + 2 * i + 30 * np.sin(2 * np.pi * i / 12) for i in range(48, 60)]
    assert np.abs(np.array(ahead) - truth).max() < 8


def test_error_metrics_and_backtest(spark):
    df = spark.createDataFrame([("a", 10, 12), ("a", 20, 16), ("a", 0, 1)], "key string, actual long, forecast long")
    row = ops.error_metrics(df).first()
    assert row["mae"] == pytest.approx(7 / 3)
    assert row["rmse"] == pytest.approx((21 / 3) ** 0.5)
    assert row["mape"] == pytest.approx(20.0)
    back = ops.backtest(frame(spark, months([10 * i for i in range(1, 13)])), 3).orderBy("month").collect()
    assert [(r["actual"], r["forecast"], r["error"]) for r in back] == [(100, 100, 0), (110, 110, 0), (120, 120, 0)]


def test_capacity_plan(spark):
    df = frame(spark, months([400, 500]))
    forecasts = spark.createDataFrame(
        [("a", dt.datetime(2018, 3, 1), 550), ("a", dt.datetime(2018, 4, 1), 20), ("a", dt.datetime(2018, 5, 1), 20000)],
        "key string, month timestamp_ntz, forecast long",
    )
    got = [tuple(r)[2:] for r in ops.capacity_plan(df, forecasts).orderBy("month").collect()]
    assert got == [(550, 10.0, 4, 1), (20, -96.0, 0, 0), (20000, 3900.0, 160, 7)]
