import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import quality, selection, uploads


def test_correlation_with_and_without_nulls(spark):
    rng = random.Random(2)
    rows = [(x := rng.random(), 2 * x + rng.random(), rng.random() if i % 3 else None, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r["column_x"], r["column_y"]): r["r"] for r in quality.correlation_matrix(df).collect()}
    assert len(got) == 16
    a, b, c = (np.array([r[i] if r[i] is not None else np.nan for r in rows]) for i in range(3))
    ok = ~np.isnan(c)
    assert got["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["b", "a"] == got["a", "b"]
    assert got["a", "c"] == pytest.approx(np.corrcoef(a[ok], c[ok])[0, 1])
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "k"] is None


def test_correlation_of_many_columns_against_pairs(spark):
    rng = np.random.default_rng(9)
    width, inf = 60, float("inf")
    base = rng.normal(0, 1, (400, 5))
    x = base @ rng.normal(0, 1, (5, width)) * np.geomspace(1e-6, 1e6, width) + np.linspace(-1e7, 1e7, width)
    x[rng.random((400, width)) < 0.1] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.where(rng.random(400) < 0.5, np.nan, 3.3)
    x[:, 9] = np.nan
    x[5, 10] = inf
    rows = [tuple(None if np.isnan(v) and rng.random() < 0.5 else float(v) for v in row) for row in x]
    names = [f"col.{i} x" for i in range(width)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    got = {(r["column_x"], r["column_y"]): r["r"] for r in quality.correlation_matrix(df).collect()}
    assert len(got) == width * width
    for i in range(width):
        for j in range(width):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if {i, j} & {7, 8, 9, 10}:
                assert got[names[i], names[j]] is None, (i, j)
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-6)
    empty = quality.correlation_matrix(df.limit(0)).collect()
    assert len(empty) in (0, width * width) and all(r["r"] is None for r in empty)
    assert quality.correlation_matrix(df.select(F.lit("x").alias("t"))).count() == 0


def test_nulls_rules_and_outliers(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (300, None), (3, "y"), (-4, "y")], "age int, t string")
    assert [tuple(r) for r in quality.null_pct(df).collect()] == [("t", 40.0)]
    rules = [("p", "age", "age < 0 OR age > 120", "age out of range"), ("p", "t", "t = 'q'", "no q")]
    assert [(r["violations"], r["status"]) for r in quality.domain_rules({"p": df}, rules).collect()] == [(2, "VIOLATED"), (0, "OK")]
    counts = quality.row_counts({"p": df}, {"p": 4}).first()
    assert (counts["actual"], counts["status"]) == (5, "MISMATCH")
    out = quality.outliers_iqr(df, ["age"]).first()
    assert (out["outliers"], out["lower_bound"], out["upper_bound"]) == (2, -2.0, 6.0)
    found = quality.implausible_values(df, {"age": "age > 2"}, list_up_to=3).first()
    assert (found["implausible"], found["listed"]) == (2, "3.00, 300.00")
    assert quality.implausible_values(df, {"age": "age > 2"}, list_up_to=1).first()["listed"] == ""
    q = {r["column_name"]: (r["distinct_values"], r["status"]) for r in quality.column_quality(df).collect()}
    assert q == {"age": (5, "ok"), "t": (2, "has missing values")}
    assert quality.missing_summary(df).first()["missing"] == 2


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(11)
    n = 20_000
    cols = {"heavy": rng.standard_cauchy(n), "even": rng.random(n), "steps": rng.integers(0, 3, n).astype(float), "flat": np.full(n, 2.0), "rare": np.where(rng.random(n) < 0.01, 9.0, 1.0)}
    rows = [tuple(None if i % 10 == 0 else float(cols[c][i]) for c in cols) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", empty double").repartition(4)
    got = {r["column_name"]: r for r in quality.outliers_iqr(df, [*cols, "empty"]).collect()}
    keep = np.arange(n) % 10 != 0
    for c, x in cols.items():
        q1, q3 = np.quantile(x[keep], [0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = int(((x[keep] < low) | (x[keep] > high)).sum())
        assert (got[c]["outliers"], got[c]["min_value"], got[c]["max_value"]) == (want, x[keep].min(), x[keep].max())
        assert got[c]["lower_bound"] == pytest.approx(low) and got[c]["outlier_pct"] == pytest.approx(100 * want / keep.sum())
    assert (got["empty"]["outliers"], got["empty"]["outlier_pct"], got["empty"]["lower_bound"]) == (0, None, None)


def test_histogram_and_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 5, 9.99, 10, 10)] + [(None,)], "x double")
    assert {r["bin"]: r["n"] for r in quality.histogram(df, "x", 2).collect()} == {0: 1, 1: 4}
    assert quality.histogram(df.where("x = 10"), "x", 5).collect()[0]["n"] == 2
    scores = spark.createDataFrame([(0, 1), (6, 1), (7, 0), (10, 1), (25, 1), (26, 1)], "s int, y int")
    got = {r["band"]: (r["n"], r["rate_pct"]) for r in quality.banded_rate(scores, "s", "y").collect()}
    assert got == {"Low": (1, 100.0), "Moderate": (2, 50.0), "Critical": (1, 100.0)}


def test_column_matching():
    assert uploads.match_columns(["Patient ID", "AdmitDate", "encounterclass", "Total Cost", "gendr", "Age_Years"]) == {
        "patient_id": "Patient ID", "encounter_date": None, "encounter_class": "encounterclass", "total_cost": "Total Cost",
        "age": "Age_Years", "gender": "gendr", "condition": None, "procedure": None, "discharge_date": None,
    }


def test_standardize(spark):
    df = spark.createDataFrame([("7", "2020-02-30", "12.5", "x"), ("8", "2020-02-03", "free", None)], ["Patient ID", "Encounter Date", "total_cost", "gender"])
    rows = uploads.standardize(df).collect()
    assert rows[0]["patient_id"] == "7" and rows[0]["encounter_date"] is None and float(rows[0]["total_cost"]) == 12.5
    assert rows[1]["total_cost"] is None and rows[1]["encounter_date"].day == 3 and rows[0]["age"] is None
    report = {r["standard_column"]: (r["level"], r["present"], r["missing_pct"]) for r in uploads.standardize_report(df).collect()}
    assert report["encounter_class"] == ("required", False, 100.0) and report["gender"] == ("recommended", True, 50.0)


def test_dates_and_choices(spark):
    df = spark.createDataFrame([("2001", "2020-01-05", 1), ("1999", "n/a", 2), ("2003", "2020-01-07", 3)], "code string, day string, n int")
    shares = {r["column_name"]: r["date_share"] for r in uploads.date_share(df).collect()}
    assert shares == {"code": 0.0, "day": pytest.approx(2 / 3)}
    assert uploads.detect_date_column(df, 0.6).first()["column_name"] == "day"
    assert [r["choice"] for r in selection.filter_choices(df, "n", 2).collect()] == ["1", "2"]
    assert selection.filter_by_value(df, "n", "3").count() == 1
    assert selection.preview(df, [F.col("n")], 2).first()["n_columns"] == 3
