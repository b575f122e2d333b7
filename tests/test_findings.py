"""Steps that once repeated work or held too much at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import joins
from wardlake.models import automl, store
from wardlake.operators import retrieval
from wardlake.plans import texts


def test_store_hands_on_what_it_fitted(spark, tmp_path, monkeypatch):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    monkeypatch.setattr(store.ModelStore, "load", lambda self, name: pytest.fail("a model that was just fitted is read back"))
    model = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    assert store.ModelStore(spark, str(tmp_path)).complete({"a": lambda: model}) == {"a": model}


def test_suggest_makes_the_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    rows = [(i % 7, float(i % 50), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "one int, two double, y string").withColumn("two", F.udf(count, "double")("two"))
    assert automl.suggest_features(df.withColumn("empty", F.lit(None)), "y").count() == 3
    assert made.value == 200


def test_training_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(automl, "TASK_ROWS", 10)
    one = spark.range(35).coalesce(1)
    assert automl._spread(one, "id").rdd.getNumPartitions() == 4
    assert sorted(r.id for r in automl._spread(one, "id").collect()) == list(range(35))
    assert automl.FOREST["cacheNodeIds"]


def test_blocks_stream_past_their_queries(spark):
    rng = np.random.default_rng(3)
    vectors = [(2**60 + i, rng.normal(size=4).tolist(), f"t{i % 3}") for i in range(300)]
    asked = [(2**61 + i, rng.normal(size=4).tolist(), f"t{i % 4}") for i in range(40)]
    items = spark.createDataFrame(vectors, "chunk_id bigint, embedding array<double>, tenant_id string")
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>, tenant_id string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # no block fits a batch
    try:
        for tenant in (None, "tenant_id"):
            found = retrieval.vector_topk(items, queries, 5, tenant=tenant, max_broadcast=10)
            plan = found._jdf.queryExecution().toString()
            assert "CoGroup" not in plan and "MapInArrow" in plan
            got = {(r.query_id, r["rank"]): r.item_id for r in found.collect()}
            want = {}
            for q, v, t in asked:
                scored = [(-round(float(np.dot(v, w)), 9), i) for i, w, o in vectors if not tenant or o == t]
                want |= {(q, place): i for place, (_, i) in enumerate(sorted(scored)[:5], 1)}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("few", [0, 1_000])
def test_components_in_one_task_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_EDGES", few)
    written = []
    monkeypatch.setattr(joins, "materialize", lambda df, name: written.append(df) or materialized(df, name))
    materialized = texts.materialize
    draw = random.Random(1)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(110)]
    found = {r.id: r.component for r in joins.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
    rounds = [df._jdf.queryExecution().executedPlan().toString() for df in written[1:]]
    assert all(("hashpartitioning" in plan) == (few == 0) for plan in rounds)


def test_index_append_makes_the_upload_once(spark, monkeypatch):
    batches = []
    own = texts.tenants.append
    monkeypatch.setattr(texts.tenants, "append", lambda df, path, batch: batches.append((batch, df)) or own(df, path, batch))
    texts.index_append(spark, "/root/testdata/sf0.001")
    uploads = [df for batch, df in batches if batch == "upload-1"]
    assert len(uploads) == 2 and all("ArrowEvalPython" not in df._jdf.queryExecution().toString() for df in uploads)
    assert all(any("upload" in f for f in df.inputFiles()) for df in uploads)
