"""Train on any table: target checks, feature suggestion, one forest with a report."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions.scalars import key_mix
from wardlake.operators import model_eval
from wardlake.models.neighbours import neighbour_information
from wardlake.scale import exact_quantiles
from wardlake.session import materialize

# Limits on targets and rows.
MAX_NUMERIC_CLASSES = 12
MAX_TEXT_CLASSES = 50
MIN_ROWS = 20
TOP_IMPORTANCES = 15
TOP_FEATURES = 12
ID_SHARE = 0.95
MI_BINS = 20
MI_CLASS_LIMIT = 10
MIN_SCORED_ROWS = 10
# Width that hashed text columns share.
HASH_WIDTH = 1 << 16
# The deepest tree MLlib grows; the plan is to let trees grow freely.
MAX_DEPTH = 30
# Training rows that fill one task.
TASK_ROWS = 20_000
# Rows remember their node instead of walking all trees again for every group of nodes.
FOREST = {"cacheNodeIds": True}

# Name fragments that give the outcome away.
LEAKY_NAMES = [
    "expected_", "_expected", "predicted", "prediction", "score",
    "outcome", "died", "death", "mortality", "expired",
    "discharge", "length_of_stay", "los", "readmit", "readmission",
    "probability", "risk_flag", "label", "target",
]
# Markers that confirm a diagnosis after the fact.
DIAGNOSTIC_MARKERS = ["creatinine", "urea", "egfr", "troponin", "lactate", "bilirubin", "inr", "d_dimer", "bnp"]
# Fragments of identifier names.
IDENTIFIER_NAMES = ["id", "name", "uuid", "identifier"]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _is_continuous(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FractionalType, T.DecimalType))


def problem_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column taken as a target: classification, regression or rejected, in one pass."""
    wide = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)],
    )
    records = []
    for i, c in enumerate(columns):
        n, u = F.col(f"n{i}"), F.col(f"u{i}")
        if is_numeric(df, c):
            kind = F.when(u <= MAX_NUMERIC_CLASSES, "classification").otherwise("regression")
        else:
            kind = F.when((u > MAX_TEXT_CLASSES) | (u > 0.5 * n), "rejected").otherwise("classification")
        records.append(
            F.struct(
                F.lit(c).alias("target"),
                n.alias("n_values"),
                u.alias("distinct_values"),
                F.when(n == 0, "rejected").otherwise(kind).alias("problem_type"),
            )
        )
    return wide.select(F.inline(F.array(*records)))


# --- feature suggestion --------------------------------------------------------------------------


def default_features(columns: Sequence[str]) -> list[str]:
    """Columns whose names do not look like identifiers."""
    return [c for c in columns if not any(fragment in c.lower() for fragment in IDENTIFIER_NAMES)]


def _letters(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def _any_of(fragments: Sequence[str]) -> Callable[[str, str], str | None]:
    return lambda column, _: next((f for f in fragments if f in column.lower()), None)


def _around_target(column: str, target: str) -> str | None:
    inner, outer = _letters(target), _letters(column)
    return target if inner and inner != outer and inner in outer else None


# Rules on names in order of precedence: what a finding is called, and the test that returns its evidence.
NAME_RULES: list[tuple[str, Callable[[str, str], str | None]]] = [
    ("built around the target", _around_target),
    ("outcome word", _any_of(LEAKY_NAMES)),
    ("late diagnostic", _any_of(DIAGNOSTIC_MARKERS)),
]


def name_findings(columns: Sequence[str], target: str) -> dict[str, str]:
    """Columns whose names rule them out for a target, with ``finding: evidence``."""
    found: dict[str, str] = {}
    for kind, test in reversed(NAME_RULES):
        found.update({c: f"{kind}: {evidence}" for c in columns if (evidence := test(c, target))})
    return found


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, float]]:
    """Row count and distinct values per column: a sketch decides the clear cases, the rest is counted exactly."""
    rough = df.agg(
        F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.02).alias(f"u{i}") for i, c in enumerate(columns)]
    ).first()
    n = rough["n"]
    counts = {c: float(rough[f"u{i}"]) for i, c in enumerate(columns)}
    unclear = [
        c for c, u in counts.items() if u <= 3 or (u >= (ID_SHARE - 0.12) * n and not _is_continuous(df, c))
    ]
    if unclear:
        exact = df.agg(*[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(unclear)]).first()
        counts.update({c: exact[i] for i, c in enumerate(unclear)})
    return n, counts


def screen_features(df: DataFrame, target: str) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """``(dropped with reason, candidates with their distinct counts)`` of all columns but the target."""
    columns = [c for c in df.columns if c != target]
    n, distinct = _distinct_counts(df, columns)
    flat = {c: "one value at most" for c in columns if distinct[c] <= 1}
    keys = {c: "a key: nearly as many values as rows" for c in columns if n and distinct[c] >= ID_SHARE * n and not _is_continuous(df, c)}
    reasons = flat | name_findings(columns, target) | keys
    return [(c, reasons[c]) for c in columns if c in reasons], {c: distinct[c] for c in columns if c not in reasons}


def _bins(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, Column]:
    """Quantile bin number per numeric column as text; missing values take the median's bin."""
    probs = [i / bins for i in range(1, bins)]
    rows = exact_quantiles(df, columns, [*probs, 0.5]).collect() if columns else []
    cuts = {r["column"]: r["q"] for r in rows}  # one row per column
    out = {}
    for c in columns:
        *edges, median = cuts[c] or [0.0]
        value = F.coalesce(F.col(c).cast("double"), F.lit(float(median)))
        below = [(value > F.lit(float(e))).cast("int") for e in edges]
        out[c] = reduce(lambda a, b: a + b, below, F.lit(0)).cast("string")
    return out


def contingency(
    df: DataFrame, target: str, candidates: Sequence[str], bins: int = MI_BINS, distinct: dict[str, float] | None = None
) -> DataFrame:
    """``(feature, bin, label, n)`` counts of all candidates in one pass."""
    numeric_target = is_numeric(df, target)
    few = True
    if numeric_target:
        few = df.select(target).where(F.col(target).isNotNull()).distinct().limit(MI_CLASS_LIMIT + 1).count() <= MI_CLASS_LIMIT
        df = df.where(F.col(target).isNotNull())
    numeric = [c for c in candidates if is_numeric(df, c)]
    known = max((distinct[c] for c in numeric), default=0.0) if distinct and few else None
    wanted = _bins(df, numeric + ([] if few else [target]), bins)
    label = F.coalesce(F.col(target).cast("string"), F.lit("Missing")) if few else wanted[target]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (wanted[c] if c in wanted else F.coalesce(F.col(c).cast("string"), F.lit("Missing"))).alias("bin"),
            )
            for c in candidates
        ]
    )
    return (
        df.select(label.alias("label"), F.explode(cells).alias("cell"))
        .groupBy("cell.feature", "cell.bin", "label")
        .agg(F.count("*").alias("n"))
    )


def mutual_information(counts: DataFrame) -> DataFrame:
    """Plug-in mutual information per feature from the counts."""
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_label = counts.groupBy("feature", "label").agg(F.sum("n").alias("nl"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("nt"))
    joined = counts.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "label"]).join(total, "feature")
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nl")))
    return joined.groupBy("feature").agg(F.sum(term.cast("decimal(28,15)")).cast("double").alias("score"))


def suggest_features(df: DataFrame, target: str, top_k: int = TOP_FEATURES, neighbours: bool = False) -> DataFrame:
    """``(column_name, verdict, reason, score)``: suggested and other candidates ranked by signal, and the dropped.

    Signal is mutual information over quantile bins. With ``neighbours``, and classes as target, number columns are
    scored by nearest neighbours instead, which sees what bins blur but sorts every column.
    """
    spark = df.sparkSession
    schema = "column_name string, verdict string, reason string, score double"
    # written once, as every pass below would repeat the joins and shuffles that made the table; files hold no void column
    df = materialize(df.withColumns({c: F.lit(None).cast("string") for c, t in df.dtypes if t == "void"}), "suggest-table")
    dropped, candidates = screen_features(df, target)
    out = spark.createDataFrame([(c, "dropped", why, None) for c, why in dropped], schema)
    if not candidates:
        return out
    if df.where(F.col(target).isNotNull()).limit(MIN_SCORED_ROWS).count() < MIN_SCORED_ROWS:
        unscored = [(c, "suggested" if i < top_k else "candidate", "", 0.0) for i, c in enumerate(candidates)]
        return out.unionByName(spark.createDataFrame(unscored, schema))
    counts = materialize(contingency(df, target, list(candidates), distinct=candidates), "contingency")
    found = mutual_information(counts).collect()  # one row per candidate column
    scores = {r["feature"]: r["score"] for r in found}
    numbers = [c for c in candidates if is_numeric(df, c)]
    if neighbours and numbers and problem_types(df, [target]).first()["problem_type"] == "classification":
        scores |= {r["feature"]: r["score"] for r in neighbour_information(df, target, numbers).collect()}
    ranked = sorted(candidates, key=lambda c: -scores.get(c, 0.0))
    with_signal = [c for c in ranked if scores.get(c, 0.0) > 1e-12]
    chosen = (with_signal or ranked)[:top_k]
    rows = [(c, "suggested" if c in chosen else "candidate", "", scores.get(c, 0.0)) for c in ranked]
    return out.unionByName(spark.createDataFrame(rows, schema))


# --- training ------------------------------------------------------------------------------------


REPORT = "part string, name string, value double"


def _stages(df: DataFrame, numeric: Sequence[str], text: Sequence[str], hashed: Sequence[str]) -> list:
    """Encoding stages: text columns become one column per value, those in ``hashed`` share a fixed width."""
    one_hot = [c for c in text if c not in hashed]
    stages: list = []
    inputs = list(numeric)
    if one_hot:
        stages.append(StringIndexer(inputCols=one_hot, outputCols=[f"{c}__ix" for c in one_hot], handleInvalid="keep"))
        stages.append(
            OneHotEncoder(inputCols=[f"{c}__ix" for c in one_hot], outputCols=[f"{c}__oh" for c in one_hot], dropLast=False)
        )
        inputs += [f"{c}__oh" for c in one_hot]
    if hashed:
        stages.append(FeatureHasher(inputCols=list(hashed), outputCol="__hashed", numFeatures=HASH_WIDTH))
        inputs.append("__hashed")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def _importances(transformed: DataFrame, weights) -> list[tuple[str, float]]:
    """Names from the vector's attributes beside the forest's importances, largest first."""
    attrs = transformed.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attrs.values() for a in group}
    pairs = [(names.get(int(i), str(i)).replace("__oh", ""), float(v)) for i, v in zip(weights.indices, weights.values)]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:TOP_IMPORTANCES]


def training_setup(data: DataFrame, target: str, features: Sequence[str]) -> tuple[str, str | None]:
    """``(kind of problem, what forbids training)``; the checks run in order and stop at the first that fails."""
    kind = "unknown"
    if features and data.limit(MIN_ROWS).count() >= MIN_ROWS:
        kind = problem_types(data, [target]).first()["problem_type"]
    checks = {
        "needs at least one feature besides the target": bool(features),
        f"needs {MIN_ROWS} rows with a target": kind != "unknown",
        "a text target needs repeating values": kind != "rejected",
    }
    return kind, next((need for need, met in checks.items() if not met), None)


def train_on_upload(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    key: str,
    trees: int = 200,
    depth: int = MAX_DEPTH,
    hashed: Sequence[str] = (),
) -> DataFrame:
    """Forest on the chosen columns with a 20% holdout, as a long report ``(part, name, value)``.

    Parts: ``fault`` (training was not possible; nothing else is listed), ``problem``, ``rows``, ``metric``,
    ``importance`` and, for classes, ``confusion`` (``actual > predicted``). ``key`` is unique per row and decides the
    split; text columns with very many values should be named in ``hashed``.
    """
    spark = df.sparkSession
    chosen = [c for c in features if c not in (target, key)]
    data = df.where(F.col(target).isNotNull()).select(key, *chosen, target)
    kind, fault = training_setup(data, target, chosen)
    if fault:
        return spark.createDataFrame([("fault", fault, None)], REPORT)

    numeric = [c for c in chosen if is_numeric(data, c)]
    text = [c for c in chosen if c not in numeric]
    if kind == "classification":
        split = model_eval.stratified_split(data.withColumn("__y", F.col(target).cast("string")), "__y", key)
    else:
        held = key_mix(F.col(key)) < F.lit(int(model_eval.TEST_SHARE * 4294967296))
        split = data.withColumns({"__y": F.col(target).cast("double"), "is_test": held})
    split = materialize(split, "upload-split")
    filled = materialize(fill_missing(split, split.where(~F.col("is_test")), numeric, text), "upload-filled")
    train, test = _spread(filled.where(~F.col("is_test")), key), filled.where("is_test")
    fit = _fit_classes if kind == "classification" else _fit_numbers
    model, predicted, scores = fit(train, test, _stages(train, numeric, text, hashed), trees, depth)
    weights = _importances(predicted, model.stages[-1].featureImportances)
    known = [("problem", kind, None), *(("importance", name, value) for name, value in weights)]
    side = F.when(F.col("is_test"), "test").otherwise("train")
    sizes = filled.groupBy(side.alias("name")).agg(F.count("*").cast("double").alias("value"))
    return spark.createDataFrame(known, REPORT).unionByName(sizes.select(F.lit("rows").alias("part"), "*")).unionByName(scores)


def _spread(train: DataFrame, key: str) -> DataFrame:
    """Training rows dealt over as many tasks as they fill, the same way each time, however few files they came from."""
    tasks = math.ceil(train.count() / TASK_ROWS)
    return train.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else train


def _as_part(wide: DataFrame, part: str) -> DataFrame:
    doubles = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return doubles.unpivot([], doubles.columns, "name", "value").select(F.lit(part).alias("part"), "name", "value")


def _fit_classes(train: DataFrame, test: DataFrame, stages: list, trees: int, depth: int) -> tuple:
    index = StringIndexer(inputCol="__y", outputCol="label", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42, **FOREST)
    model = Pipeline(stages=[index, *stages, forest]).fit(model_eval.with_weights(train, "__y"))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    predicted = named.transform(model.transform(test))
    cells = predicted.groupBy(F.concat_ws(" > ", "__y", "predicted").alias("name")).agg(F.count("*").cast("double").alias("value"))
    report = _as_part(model_eval.classification_report(predicted, "__y", "predicted"), "metric")
    return model, predicted, report.unionByName(cells.select(F.lit("confusion").alias("part"), "name", "value"))


def _fit_numbers(train: DataFrame, test: DataFrame, stages: list, trees: int, depth: int) -> tuple:
    forest = RandomForestRegressor(labelCol="__y", numTrees=trees, maxDepth=depth, seed=42, **FOREST)
    model = Pipeline(stages=[*stages, forest]).fit(train)
    predicted = model.transform(test)
    return model, predicted, _as_part(model_eval.regression_report(predicted, "__y", "prediction"), "metric")


def fill_missing(df: DataFrame, train: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Fill the whole frame with values fitted on its training rows only."""
    fills: dict[str, Column] = {}
    if numeric:
        for r in exact_quantiles(train, numeric, [0.5]).collect():  # one row per column
            fills[r["column"]] = F.coalesce(F.col(r["column"]).cast("double"), F.lit(r["q"][0] if r["q"] else 0.0))
    if text:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in text])).alias("cell")
        counted = train.select(cells).where("cell.v IS NOT NULL").groupBy("cell.c", "cell.v").agg(F.count("*").alias("n"))
        # the most frequent value, of equals the first; one row per column
        best = counted.groupBy("c").agg(F.max("n").alias("n")).join(counted, ["c", "n"]).groupBy("c").agg(F.min("v").alias("v"))
        tops = {r["c"]: r["v"] for r in best.collect()}
        fills.update({c: F.coalesce(F.col(c).cast("string"), F.lit(tops.get(c, "Missing"))) for c in text})
    return df.withColumns(fills) if fills else df
