"""Registered queries: splits, metrics, risk models and training on uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.functions.scalars import key_mix
from wardlake.models import automl, risk
from wardlake.operators import features as feats
from wardlake.operators import model_eval as ops
from wardlake.plans.features import FLAGS, VITALS, assembled_of
from wardlake.plans.registry import query
from wardlake.session import materialize

MULTIPLIERS = {"one": 2654435761, "two": 2246822519, "three": 3266489917}


def score_table(spark, d):
    """Scores of three stand-in models for two labels over all orders, with many ties."""
    orders = C.table(spark, d, "orders")
    mixes = F.array(
        *[
            F.struct(F.lit(name).alias("model"), (F.floor((F.col("o_orderkey") * F.lit(m) % F.lit(4294967296)) / F.lit(1048576)) / 4096.0).alias("score"))
            for name, m in MULTIPLIERS.items()
        ]
    )
    labels = F.array(
        F.struct(F.lit("high_value").alias("risk"), (F.col("o_totalprice") >= 250000).cast("int").alias("label")),
        F.struct(F.lit("finished").alias("risk"), (F.col("o_orderstatus") == "F").cast("int").alias("label")),
    )
    return orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.explode(labels).alias("l")).select(
        "l.risk", "l.label", F.explode(mixes).alias("m"), "o_orderkey"
    ).select("risk", "label", "m.model", "m.score", "o_orderkey")


SQL_SCORES = """scores AS (SELECT risk, model, CAST(floor((o_orderkey * mult % 4294967296) / 1048576) AS DOUBLE) / 4096.0 AS score,
        CASE risk WHEN 'high_value' THEN (o_totalprice >= 250000)::INT ELSE (o_orderstatus = 'F')::INT END AS label
        FROM orders, (VALUES ('one', 2654435761), ('two', 2246822519), ('three', 3266489917)) m(model, mult),
             (VALUES ('high_value'), ('finished')) r(risk)),
    per_score AS (SELECT risk, model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY 1, 2, 3),
    cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY risk, model) AS p,
        sum(neg) OVER (PARTITION BY risk, model) AS n FROM per_score WINDOW w AS (PARTITION BY risk, model ORDER BY score DESC)),
    areas AS (SELECT risk, model,
        CAST(sum(CAST(pos * (2 * (n - fp) + neg) AS DECIMAL(38,0))) AS DOUBLE) / (2.0::DOUBLE * max(p) * max(n)) AS roc_auc,
        CAST(sum(CAST(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) AS DECIMAL(38,9))) AS DOUBLE) / CAST(max(p) AS DOUBLE) AS pr_auc
        FROM cum GROUP BY 1, 2)"""
GROUPS = ["risk", "model"]

SQL_SHUFFLED = """placed AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)"""


@query(
    "stratified_split",
    f"WITH {SQL_SHUFFLED} SELECT o_orderkey, o_orderstatus, rn <= n * CAST(0.2 AS DOUBLE) AS is_test, (rn - 1) % 5 AS fold FROM placed",
)
def stratified_split(spark, d):
    orders = C.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    split = ops.stratified_split(orders, "o_orderstatus", "o_orderkey")
    folds = ops.stratified_folds(orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")
    return split.join(folds, "o_orderkey")


@query(
    "class_weights",
    """SELECT o_orderstatus, count(*) AS n,
       CAST((SELECT count(*) FROM orders) AS DOUBLE) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)) AS weight
       FROM orders GROUP BY 1""",
)
def class_weights(spark, d):
    return ops.class_weights(C.table(spark, d, "orders"), "o_orderstatus")


@query("roc_auc", f"WITH {SQL_SCORES} SELECT risk, model, roc_auc FROM areas")
def roc_auc(spark, d):
    return ops.roc_auc(score_table(spark, d), GROUPS)


@query("average_precision", f"WITH {SQL_SCORES} SELECT risk, model, pr_auc FROM areas")
def average_precision(spark, d):
    return ops.average_precision(score_table(spark, d), GROUPS)


@query(
    "roc_pr_curves",
    f"""WITH {SQL_SCORES} SELECT risk, model, score, CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) AS tpr,
        CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision, CAST(p AS DOUBLE) / CAST(p + n AS DOUBLE) AS baseline FROM cum""",
)
def roc_pr_curves(spark, d):
    return ops.roc_pr_curves(score_table(spark, d), GROUPS)


@query(
    "model_metrics",
    f"""WITH {SQL_SCORES}, cells AS (SELECT risk, model, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
        count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
        count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM scores GROUP BY 1, 2)
        SELECT risk, model, tn, fp, fn, tp, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, roc_auc, pr_auc
        FROM cells JOIN areas USING (risk, model)""",
)
def model_metrics(spark, d):
    return ops.model_metrics(score_table(spark, d), GROUPS)


def stay_features(spark, d):
    """Feature matrix with all targets, written once so that every fit reads files."""
    stays = materialize(assembled_of(spark, d), "stays")
    return materialize(feats.high_cost(feats.feature_matrix(stays, VITALS)), "features")


@query("train_risk_models")
def train_risk_models(spark, d):
    _, scores = risk.train_all(stay_features(spark, d), FLAGS, VITALS, risk.Settings())
    return ops.model_metrics(scores, GROUPS)


@query("cross_validate")
def cross_validate(spark, d):
    features = stay_features(spark, d)
    _, scores = risk.train_all(features, FLAGS, VITALS, risk.Settings())
    best = risk.best_models(ops.model_metrics(scores, GROUPS))
    return risk.cross_validate(features, best, FLAGS, VITALS, risk.Settings())


@query("risk_scores")
def risk_scores(spark, d):
    features = stay_features(spark, d)
    models, scores = risk.train_all(features, FLAGS, VITALS, risk.Settings())
    best = risk.best_models(ops.model_metrics(scores, GROUPS))
    return risk.score_stays(features, models, best)


@query("what_if_scores")
def what_if_scores(spark, d):
    """Each risk's best model asked about one made-up stay: the cohort's medians at age 80."""
    features = stay_features(spark, d)
    models, scores = risk.train_all(features, FLAGS, VITALS, risk.Settings())
    best = risk.best_models(ops.model_metrics(scores, GROUPS))
    columns = sorted({c for target in feats.TARGETS for c in risk.feature_columns(target, FLAGS, VITALS)})
    asked = risk.what_if(features, columns, {"age": 80.0})
    return risk.score_stays(asked, models, best)


_TARGETS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_TEXT = {"o_orderstatus", "o_orderdate", "o_orderpriority"}


def _sql_problem(c):
    u, n = f"count(DISTINCT {c})", f"count({c})"
    kind = (
        f"CASE WHEN {u} > 50 OR {u} > 0.5 * {n} THEN 'rejected' ELSE 'classification' END"
        if c in _TEXT
        else f"CASE WHEN {u} <= 12 THEN 'classification' ELSE 'regression' END"
    )
    return f"SELECT '{c}' AS target, {n} AS n_values, {u} AS distinct_values, CASE WHEN {n} = 0 THEN 'rejected' ELSE {kind} END AS problem_type FROM orders"


@query("detect_problem_type", " UNION ALL ".join(_sql_problem(c) for c in _TARGETS))
def detect_problem_type(spark, d):
    return automl.problem_types(C.table(spark, d, "orders"), _TARGETS)


@query(
    "classification_report",
    """WITH p AS (SELECT o_orderstatus AS y, CASE (o_orderkey * 2654435761) % 4294967296 % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P'
             ELSE o_orderstatus END AS z FROM orders),
    c AS (SELECT k, count(*) FILTER (y = k) AS s, count(*) FILTER (z = k) AS m, count(*) FILTER (y = k AND z = k) AS h
          FROM p, (SELECT y AS k FROM p UNION SELECT z FROM p) GROUP BY k),
    r AS (SELECT *, coalesce(h / nullif(m, 0), 0.0) AS pr, coalesce(h / nullif(s, 0), 0.0) AS rc, coalesce(2 * h / nullif(s + m, 0), 0.0) AS f FROM c)
    SELECT CAST(sum(h) AS DOUBLE) / sum(s) AS accuracy, CAST(sum(CAST(s * pr AS DECIMAL(38,9))) AS DOUBLE) / sum(s) AS precision,
        CAST(sum(CAST(s * rc AS DECIMAL(38,9))) AS DOUBLE) / sum(s) AS recall, CAST(sum(CAST(s * f AS DECIMAL(38,9))) AS DOUBLE) / sum(s) AS f1 FROM r""",
)
def classification_report(spark, d):
    draw = key_mix(F.col("o_orderkey")) % 4
    guess = F.when(draw == 0, "F").when(draw == 1, "O").when(draw == 2, "P").otherwise(F.col("o_orderstatus"))
    predictions = C.table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), guess.alias("z"))
    return ops.classification_report(predictions, "y", "z")


@query("regression_report")
def regression_report(spark, d):
    lines = C.table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("guess"))
    return ops.regression_report(lines, "l_extendedprice", "guess")


def graded_documents(spark, d):
    return C.table(spark, d, "labels").join(C.table(spark, d, "documents").drop("text"), "doc_id")


_CANDIDATES = {"o_orderpriority": "CAST(o_orderpriority AS VARCHAR)", "l_quantity": None, "l_extendedprice": None, "l_linenumber": None,
               "l_linestatus": "CAST(l_linestatus AS VARCHAR)"}


def _sql_bin(c):
    if _CANDIDATES[c]:
        return f"coalesce({_CANDIDATES[c]}, 'Missing')"
    cuts = f"(SELECT quantile_cont({c}, [{', '.join(str(i / 20) for i in range(1, 20))}]) FROM lines)"
    return f"CAST(len(list_filter({cuts}, lambda e: e < {c})) AS VARCHAR)"


SUGGEST_COLUMNS = ["row_id", "l_quantity", "l_extendedprice", "l_linenumber", "l_linestatus", "o_orderpriority", "risk_score", "one", "l_returnflag"]


@query(
    "suggest_features",
    """WITH lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    cells AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_sql_bin(c)} AS bin, l_returnflag AS label FROM lines" for c in _CANDIDATES)
    + """), n AS (SELECT feature, bin, label, count(*) AS n FROM cells GROUP BY 1, 2, 3),
    mi AS (SELECT feature, sum(n / nt * ln(n * nt / (nb * nl))) AS score FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS nt,
        CAST(sum(n) OVER (PARTITION BY feature, bin) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY feature, label) AS DOUBLE) AS nl FROM n) GROUP BY 1)
    SELECT feature AS column_name, 'suggested' AS verdict, '' AS reason, row_number() OVER (ORDER BY score DESC) AS place FROM mi
    UNION ALL VALUES ('row_id', 'dropped', 'a key: nearly as many values as rows', 0), ('risk_score', 'dropped', 'outcome word: score', 0),
        ('one', 'dropped', 'one value at most', 0)""",
)
def suggest_features(spark, d):
    from pyspark.sql import Window

    lines = C.table(spark, d, "lineitem").join(C.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # order, line, part, supplier, quantity and price together tell the lines apart
    table = lines.withColumns(
        {
            "row_id": F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
            "risk_score": F.col("l_quantity") + 1,
            "one": F.lit(1),
        }
    ).select(*SUGGEST_COLUMNS)
    found = automl.suggest_features(table, "l_returnflag")
    # the verdicts are one row per column of the table
    place = F.when(F.col("verdict") == "dropped", 0).otherwise(
        F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("score")))
    )
    return found.select("column_name", "verdict", "reason", place.cast("bigint").alias("place"))


@query("suggest_by_neighbours")
def suggest_by_neighbours(spark, d):
    """Graded documents: what tells the toxic ones, numbers scored by nearest neighbours."""
    return automl.suggest_features(graded_documents(spark, d).drop("doc_id"), "toxic", neighbours=True)


@query("automl_train")
def automl_train(spark, d):
    table = graded_documents(spark, d)
    report = automl.train_on_upload(table, "quality", ["lang", "source", "n_chars", "toxic"], "doc_id")
    return report.select(F.col("part").alias("kind"), "name", "value")
