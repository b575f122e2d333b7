import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from wardlake.models import automl, risk
from wardlake.models.neighbours import neighbour_information
from wardlake.models.store import ModelStore, fingerprint
from wardlake.operators import model_eval as ops
from wardlake.plans import models as plans


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(y for y, _ in rows)
    out = last = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(y for y, s in rows if s >= t)
        n = sum(s >= t for _, s in rows)
        out += (tp / total - last) * tp / n
        last = tp / total
    return out


def scores(spark, rows, model="m"):
    return spark.createDataFrame([(model, y, s) for y, s in rows], "model string, label int, score double")


def test_areas_with_ties(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), rng.choice([round(rng.random(), 1), rng.random() / 3, 0.0, 1.0])) for _ in range(200)]
    got = ops.model_metrics(scores(spark, rows), ["model"]).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    assert got["pr_auc"] == pytest.approx(brute_ap(rows), abs=1e-9)
    assert got["tp"] == sum(y == 1 and s >= 0.5 for y, s in rows) and got["fn"] == sum(y == 1 and s < 0.5 for y, s in rows)


def test_average_precision_is_stepwise(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5)]
    assert ops.average_precision(scores(spark, rows), ["model"]).first()["pr_auc"] == pytest.approx(0.7555555, abs=1e-6)


def test_undefined_metrics(spark):
    negatives = ops.model_metrics(scores(spark, [(0, 0.1), (1, 0.2)]), ["model"]).first()
    assert (negatives["precision"], negatives["recall"], negatives["f1"]) == (0.0, 0.0, 0.0)
    single = ops.model_metrics(scores(spark, [(1, 0.4), (1, 0.6)]), ["model"]).first()
    assert single["roc_auc"] is None and single["pr_auc"] == pytest.approx(1.0)


def test_split_and_folds(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    split = ops.stratified_split(df, "y", "id")
    sizes = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    assert sorted(split.collect()) == sorted(ops.stratified_split(df.repartition(7), "y", "id").collect())
    folds = {(r["y"], r["fold"]): r["count"] for r in ops.stratified_folds(df, "y", "id").groupBy("y", "fold").count().collect()}
    assert set(folds.values()) == {180, 20} and len(folds) == 10


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {r["y"]: r["weight"] for r in ops.class_weights(df, "y").collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    pos = ops.positive_weight(df, "y").first()
    assert pos["positive_weight"] == 3.0 and pos["too_few"]


def test_reports(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("c", "c")]
    got = ops.classification_report(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert got["accuracy"] == pytest.approx(4 / 6)
    assert got["precision"] == pytest.approx((2 * 0.5 + 1 * 0.5 + 3 * 1.0) / 6)
    assert got["recall"] == pytest.approx((2 * 0.5 + 1 + 3 * 2 / 3) / 6)
    assert got["f1"] == pytest.approx((2 * 0.5 + 1 * 2 / 3 + 3 * 0.8) / 6)
    reg = ops.regression_report(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "y double, p double"), "y", "p").first()
    assert (reg["r2"], reg["mae"], reg["rmse"]) == (pytest.approx(0.0), pytest.approx(2 / 3), pytest.approx((2 / 3) ** 0.5))


def test_problem_types(spark):
    df = spark.range(200).select(
        (F.col("id") % 12).alias("n12"),
        (F.col("id") % 13).alias("n13"),
        (F.col("id") % 50).cast("string").alias("t50"),
        (F.col("id") % 51).cast("string").alias("t51"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") < 10, F.col("id").cast("string")).alias("mostly_distinct"),
    )
    got = {r["target"]: r["problem_type"] for r in automl.problem_types(df, df.columns).collect()}
    assert got == {
        "n12": "classification", "n13": "regression", "t50": "classification", "t51": "rejected",
        "none": "rejected", "mostly_distinct": "rejected",
    }


def test_name_rules():
    found = automl.name_findings(["Expected_Mortality", "mortality", "age", "serum_creatinine", "Score 2"], "mortality")
    assert found == {
        "Expected_Mortality": "built around the target: mortality",
        "mortality": "outcome word: mortality",
        "serum_creatinine": "late diagnostic: creatinine",
        "Score 2": "outcome word: score",
    }
    assert automl.default_features(["age", "patient_id", "Doctor Name", "UUID"]) == ["age"]


def upload(spark, n=400):
    return spark.range(n).select(
        "id",
        (F.rand(1) * 100).alias("bmi"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("group"),
        (F.col("id") % 7).alias("noise"),
        F.lit(3).alias("constant"),
    ).withColumn("target_flag", F.when(F.col("group") == "x", 1).otherwise(0))


def test_suggest(spark):
    df = upload(spark).withColumnRenamed("target_flag", "sick")
    rows = automl.suggest_features(df, "sick").collect()
    dropped = {r["column_name"]: r["reason"] for r in rows if r["verdict"] == "dropped"}
    assert dropped == {"id": "a key: nearly as many values as rows", "constant": "one value at most"}
    ranked = [r["column_name"] for r in sorted((r for r in rows if r["verdict"] != "dropped"), key=lambda r: -r["score"])]
    assert ranked[0] == "group" and set(ranked) == {"group", "bmi", "noise"}


def plain_information(x, y, k=3):
    """The neighbour estimate by comparing every pair."""
    gamma = 0.5772156649015329
    psi = lambda n: -gamma + sum(1 / i for i in range(1, int(n)))
    sizes = {c: int((y == c).sum()) for c in set(y)}
    keep = np.array([sizes[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    ks, ms = [], []
    for i in range(len(x)):
        own = np.sort(np.abs(x[(y == y[i]) & (np.arange(len(x)) != i)] - x[i]))
        kk = min(k, len(own))
        d = own[kk - 1]
        away = np.abs(x - x[i])
        ks.append(kk)
        ms.append(int((away < d).sum()) if d > 0 else int((away == 0).sum()))
    mean = lambda values: sum(map(psi, values)) / len(values)
    return max(0.0, psi(len(x)) + mean(ks) - mean([sizes[c] for c in y]) - mean(ms))


def test_neighbour_information_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    n = 2000
    y = rng.choice(["a", "b", "c", "few"], n, p=[0.6, 0.3, 0.097, 0.003])
    y[5], y[6] = "alone", "two"
    y[7] = "two"
    exact = lambda v: np.round(v * 2**20) / 2**20  # sums and differences without rounding
    cols = {
        "shifted": exact(rng.normal(0, 1, n) + (y == "b") * 2.0), "noise": exact(rng.random(n)), "ties": rng.integers(0, 5, n).astype(float),
        "ring": exact(np.where(y == "a", rng.choice([-3, 3], n), 0) + rng.normal(0, 0.3, n)), "flat": np.ones(n),
    }
    rows = [(str(y[i]), *(float(v[i]) for v in cols.values()), None if i % 4 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in cols) + ", gaps double").repartition(5)
    for block_rows in (50_000, 64):
        got = {r["feature"]: r["score"] for r in neighbour_information(df, "y", [*cols, "gaps"], block_rows=block_rows).collect()}
        for c, x in cols.items():
            assert got[c] == pytest.approx(plain_information(x, y), abs=1e-9), c
        present = np.arange(n) % 4 == 0
        assert got["gaps"] == pytest.approx(plain_information(np.arange(n)[present].astype(float), y[present]), abs=1e-9)
    assert got["ring"] > got["shifted"] > 0.1 > got["noise"]
    ranked = automl.suggest_features(df.select("y", *cols), "y", neighbours=True).where("verdict <> 'dropped'").collect()
    assert max(ranked, key=lambda r: r["score"])["column_name"] == "ring"


def report_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["part"], {})[r["name"]] = r["value"]
    return out


def test_train_on_upload(spark):
    df = upload(spark)
    good = report_of(automl.train_on_upload(df, "target_flag", ["bmi", "group", "noise"], "id", trees=10, depth=4))
    assert "fault" not in good and list(good["problem"]) == ["classification"]
    assert sum(good["rows"].values()) == 400 and sum(good["confusion"].values()) == good["rows"]["test"]
    assert good["metric"]["accuracy"] > 0.95
    assert max(good["importance"], key=good["importance"].get).startswith("group")
    hashed = report_of(automl.train_on_upload(df, "target_flag", ["bmi", "group"], "id", trees=10, depth=4, hashed=["group"]))
    assert 0 <= hashed["metric"]["accuracy"] <= 1  # few of the forest's columns hold the hashed ones
    reg = report_of(automl.train_on_upload(df, "bmi", ["group", "noise"], "id", trees=5, depth=3))
    assert list(reg["problem"]) == ["regression"] and "confusion" not in reg
    text = df.withColumn("free", F.concat(F.lit("t"), F.col("id")))
    for frame, target, need in ((df, "bmi", "feature"), (df.limit(19), "target_flag", "20 rows"), (text, "free", "repeating")):
        fault = report_of(automl.train_on_upload(frame, target, ["bmi"], "id"))
        assert list(fault) == ["fault"] and need in next(iter(fault["fault"]))


def test_what_if(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 7.0), (2.0, 9.0)], "a double, b double")
    row = risk.what_if(df, ["a", "b"], {"b": 1}).first()
    assert (row["a"], row["b"]) == (2.0, 1.0)
    with pytest.raises(ValueError):
        risk.what_if(df, ["a", "b"], {"c": 1})


def test_balanced_counts(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "label double")
    got = [r["w"] for r in df.select(risk.balanced({0.0: 6, 1.0: 2}).alias("w")).collect()]
    assert got == [pytest.approx(8 / 12), pytest.approx(2.0)]


def test_risk_models_are_trained_stored_chosen_and_used(spark, tmp_path, monkeypatch):
    import os

    from wardlake.operators import features as feats
    from wardlake.operators import model_eval
    from wardlake.plans.features import FLAGS, VITALS
    from wardlake.plans.models import stay_features

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables not present")
    stays = stay_features(spark, "/root/testdata/sf0.001")
    small = risk.Settings(trees=3, forest_depth=3, rounds=2, max_iter=5)
    target = next(iter(feats.TARGETS))
    models, scores = risk.train_all(stays, FLAGS, VITALS, small, [target], save_to=str(tmp_path))
    metrics = model_eval.model_metrics(scores, ["risk", "model"])
    assert {r["model"] for r in metrics.collect()} == set(small.models)
    best = risk.best_models(metrics)
    loaded = risk.load_models(risk.store_of(stays, small, str(tmp_path)), list(models))
    one = {r["encounter_id"]: r["risk_pct"] for r in risk.score_stays(stays, models, best).collect()}
    two = {r["encounter_id"]: r["risk_pct"] for r in risk.score_stays(stays, loaded, best).collect()}
    assert one == two and len(one) == stays.count() and all(0 <= v <= 100 for v in one.values())
    folds = risk.cross_validate(stays, best, FLAGS, VITALS, small, [target], folds=2).collect()
    assert {r["metric"] for r in folds} == set(risk.CV_METRICS) and all(0 <= r["mean"] <= 1 for r in folds)
    # a second run fits nothing again
    fitted = []
    monkeypatch.setattr(risk, "fit_one", lambda *a: fitted.append(a))
    again, _ = risk.train_all(stays, FLAGS, VITALS, small, [target], save_to=str(tmp_path))
    assert again.keys() == models.keys() and not fitted
    two = {r["encounter_id"]: r["risk_pct"] for r in risk.score_stays(stays, again, best).collect()}
    assert one == two


def constant(value):
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {value} AS v FROM __THIS__")])


def test_store_goes_on_where_a_run_stopped(spark, tmp_path):
    path = str(tmp_path / "store")
    fitted = []

    def fit(name, fails=False):
        def run():
            fitted.append(name)
            if fails:
                raise ArithmeticError(name)
            return constant(len(name))

        return run

    store = ModelStore(spark, path)
    assert store.finished() == {}
    with pytest.raises(ArithmeticError):
        store.complete({"a": fit("a"), "bb": fit("bb", fails=True), "ccc": fit("ccc")})
    assert set(store.finished()) == {"a", "ccc"}
    constant(9).write().overwrite().save(f"{path}/models/bb")  # written, but never entered: a run that died in between
    models = ModelStore(spark, path).complete({n: fit(n) for n in ("a", "bb", "ccc")}, workers=1)
    assert sorted(fitted) == ["a", "bb", "bb", "ccc"]
    assert {n: m.transform(spark.range(1)).first()["v"] for n, m in models.items()} == {"a": 1, "bb": 2, "ccc": 3}


def test_fingerprint_follows_rows_and_settings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "x int, y string")
    one = fingerprint(df, risk.Settings())
    assert one == fingerprint(df.repartition(3).select("y", "x"), risk.Settings())
    assert one != fingerprint(df, risk.Settings(trees=2))
    assert one != fingerprint(df.where("x < 3"), risk.Settings()) != fingerprint(df.distinct(), risk.Settings())


def test_one_class_targets_and_folds(spark, monkeypatch):
    df = spark.range(40).select(
        F.concat(F.lit("e"), F.col("id")).alias("encounter_id"), (F.col("id") % 7).cast("double").alias("x"),
        F.lit(0).alias("never"), F.lit(1).alias("always"), (F.col("id") == 3).cast("int").alias("once"),
    )
    monkeypatch.setattr(risk, "feature_columns", lambda target, flags, vitals: ["x"])
    small = risk.Settings(trees=2, forest_depth=2, rounds=2, max_iter=3)
    models, scores = risk.train_all(df, [], [], small, ["never", "always", "once"])
    found = {(r["risk"], r["model"]): r for r in ops.model_metrics(scores, ["risk", "model"]).collect()}
    assert len(found) == 9
    for name in small.models:
        assert found["never", name]["tn"] == 8 and found["always", name]["tp"] == 8
        assert found["never", name]["roc_auc"] is None
    best = risk.best_models(ops.model_metrics(scores, ["risk", "model"]))
    assert set(best) == {"never", "always", "once"}
    shown = {(r["risk"], r["risk_pct"]) for r in risk.score_stays(df, models, best).where("risk <> 'once'").collect()}
    assert shown == {("never", 0.0), ("always", 100.0)}
    folds = risk.cross_validate(df, best, [], [], small, ["never", "once"], folds=3).collect()
    assert {r["risk"] for r in folds} == {"never", "once"}


@pytest.mark.parametrize("name", ["train_risk_models", "cross_validate", "risk_scores", "what_if_scores"])
def test_registered_queries_fit_the_full_sizes(monkeypatch, name):
    seen = []
    monkeypatch.setattr(plans, "stay_features", lambda spark, d: None)
    monkeypatch.setattr(plans.ops, "model_metrics", lambda scores, groups: None)
    monkeypatch.setattr(risk, "train_all", lambda f, flags, vitals, s=None: (seen.append(s or risk.Settings()), ({}, None))[1])
    monkeypatch.setattr(risk, "cross_validate", lambda f, best, flags, vitals, s=None: seen.append(s or risk.Settings()))
    monkeypatch.setattr(risk, "best_models", lambda metrics: {})
    monkeypatch.setattr(risk, "score_stays", lambda f, models, best: None)
    monkeypatch.setattr(risk, "what_if", lambda f, columns, overrides: None)
    getattr(plans, name)(None, "")
    full = risk.Settings(trees=300, forest_depth=30, rounds=300, max_iter=1000)
    assert seen == [full] * (2 if name == "cross_validate" else 1)
