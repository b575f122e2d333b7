import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlake import scale


def skewed(spark, n=4000):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 40}", rng.randrange(500), i, rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int")


def test_running_equals_plain_window(spark):
    df = skewed(spark)
    got = scale.running(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], {"upto": F.col("v")}, {"all": F.col("v")}, {"x": F.col("id")})
    order = Window.partitionBy("k").orderBy("t", "id")
    want = df.select(
        "*",
        F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("v").over(Window.partitionBy("k")).alias("all"),
        F.bit_xor("id").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
    )
    assert sorted(got.collect()) == sorted(want.collect())


def test_row_numbers_with_null_key_and_no_key(spark):
    df = skewed(spark, 600).withColumn("k", F.when(F.col("k") != "k3", F.col("k")))
    for keys in (["k"], []):
        got = scale.row_numbers(df, keys, F.floor(F.col("t") / 7), [F.col("t"), F.col("id")], "rn", "n")
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "id")).cast("long")).withColumn(
            "n", F.count("*").over(Window.partitionBy(*keys))
        )
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_exact_quantiles_both_paths(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.lognormal(0, 2, 3000)] + [5.0] * 1500
    rows = [("a" if i % 4 else "b", v, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double, empty double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for state in (10**6, 5):
        (row,) = scale.exact_quantiles(df, ["x"], probs, max_state=state).collect()
        assert np.allclose(row["q"], np.quantile(values, probs), rtol=1e-12)
        for r in scale.exact_quantiles(df, ["x"], probs, ["g"], max_state=state).collect():
            own = [v for g, v, _ in rows if g == r["g"]]
            assert np.allclose(r["q"], np.quantile(own, probs), rtol=1e-12)


def test_exact_quantiles_single_value_and_nulls(spark):
    df = spark.createDataFrame([(1.5, None), (1.5, None), (None, None)], "x double, y double")
    for state in (100, 0):
        found = {r["column"]: r["q"] for r in scale.exact_quantiles(df, ["x", "y"], [0.5], max_state=state).collect()}
        assert found["x"] == [1.5]
        assert not found.get("y")


def test_quantiles_of_many_rows_against_numpy(spark):
    rng = np.random.default_rng(8)
    n = 60_000
    cols = {
        "smooth": rng.normal(5, 2, n), "steps": rng.integers(0, 7, n).astype(float), "far": rng.lognormal(0, 6, n),
        "sorted": np.arange(n, dtype=float), "flat": np.full(n, 3.0), "gap": np.where(rng.random(n) < 0.25, -1e300, 1e300),
    }
    path_rows = [tuple(float(cols[c][i]) for c in cols) + ("hot" if i % 3 else None if i % 9 else "rare",) for i in range(n)]
    df = spark.createDataFrame(path_rows, ", ".join(f"{c} double" for c in cols) + ", g string").repartition(6)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["column"]: r["q"] for r in scale.exact_quantiles(df, list(cols), probs, max_state=0).collect()}
    for c in cols:
        assert np.allclose(got[c], np.quantile(cols[c], probs), rtol=1e-12), c
    for r in scale.exact_quantiles(df, ["smooth", "steps"], probs, ["g"], max_state=0).collect():
        own = np.array([row[-1] == r["g"] for row in path_rows])
        assert np.allclose(r["q"], np.quantile(cols[r["column"]][own], probs), rtol=1e-12)


def test_fits_rows(spark):
    assert scale.fits_rows(spark.range(5), 5)
    assert not scale.fits_rows(spark.range(6), 5)


def test_sorted_running_equals_plain_window_with_hot_and_null_keys(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != "k3", F.col("k"))).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    got = scale.sorted_running(df, ["k"], [F.col("t"), F.col("id")], {"upto": F.col("v")})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(order).alias("upto"))
    assert sorted(map(tuple, got.drop("__part").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    hot = got.where("k = 'hot'").groupBy("__part").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 2000  # the hot key fills several partitions
    empty = scale.sorted_running(df.limit(0), ["k"], [F.col("t")], {"upto": F.col("v")})
    assert empty.count() == 0
