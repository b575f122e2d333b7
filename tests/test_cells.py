import numpy as np
import pytest

from wardlake.operators import cells, retrieval

ROWS = "chunk_id long, tenant_id string, embedding array<double>, cell int, n int"
ASKED = "query_id long, tenant_id string, embedding array<double>, tenant int"


def clustered(rng, n, dim, groups):
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(0, groups, n)] + rng.normal(scale=0.05, size=(n, dim))


def brute(rows, queries, k):
    out = set()
    for q, tenant, v in queries:
        own = [(-round(float(np.dot(x, v)), 9), i) for i, t, x in rows if t == tenant and t is not None and x is not None]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(own)[:k], 1)}
    return out


def frames(spark, rows, queries):
    vectors = spark.createDataFrame([(i, t, x if x is None else [float(c) for c in x], 9, 9) for i, t, x in rows], ROWS)
    return vectors.repartition(5), spark.createDataFrame([(i, t, [float(c) for c in v], 9) for i, t, v in queries], ASKED)


@pytest.mark.parametrize("max_queries", [4096, 7])
def test_equals_full_comparison_and_scores_fewer_pairs(spark, tmp_path, max_queries):
    rng = np.random.default_rng(5)
    data = clustered(rng, 3000, 6, 40)
    data[100:160] = data[0]  # ties
    tenant = lambda i: ["hot", "hot", "hot", "hot", "007", "7", "", "a b/c"][i % 8]
    rows = [(i, tenant(i), x) for i, x in enumerate(data)] + [(9001, None, data[0]), (9002, "hot", None), (9003, "lonely", data[3])]
    queries = [(i, tenant(i), data[i]) for i in range(16)] + [(50, "lonely", data[0]), (51, "nobody", data[0])]
    vectors, asked = frames(spark, rows, queries)
    path = str(tmp_path / "store")
    cells.write_cells(vectors, path, "tenant_id", cell_rows=8)
    got = cells.search_cells(spark, path, asked, 7, "tenant_id", max_queries=max_queries)
    assert {(r.query_id, r.item_id, r["rank"]) for r in got.found.collect()} == brute(rows, queries, 7)
    # 1500 rows of the hot tenant for 8 queries, 375 of the others, one of the lonely one
    assert got.all_pairs == 8 * 1500 + 8 * 375 + 1 and got.scored_pairs < 0.25 * got.all_pairs
    plan = got.found._jdf.queryExecution().toString()
    assert "PartitionFilters: [tenant" in plan and "Cartesian" not in plan


def test_without_tenants_and_all_of_a_tenant(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, "x", v) for i, v in enumerate(rng.normal(size=(300, 4)))]
    queries = [(i, "x", v) for i, v in enumerate(rng.normal(size=(5, 4)))] + [(7, "x", np.zeros(4))]
    vectors, asked = frames(spark, rows, queries)
    path = str(tmp_path / "store")
    cells.write_cells(vectors, path, cell_rows=20)
    assert len(cells.stored_vectors(spark, path).select("cell").distinct().collect()) > 5
    for k in (3, 1000):
        got = cells.search_cells(spark, path, asked, k)
        assert {(r.query_id, r.item_id, r["rank"]) for r in got.found.collect()} == brute(rows, queries, k)
    plain = retrieval.vector_topk(vectors, asked, 3)
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r) for r in cells.search_cells(spark, path, asked, 3).found.collect())


def test_no_queries_and_no_vectors(spark, tmp_path):
    vectors, asked = frames(spark, [(1, "a", [1.0, 0.0])], [(1, "b", [1.0, 0.0])])
    path = str(tmp_path / "store")
    cells.write_cells(vectors, path, "tenant_id")
    for none in (asked, asked.where("false")):
        got = cells.search_cells(spark, path, none, 3, "tenant_id")
        assert got.found.count() == 0 and got.scored_pairs == got.all_pairs == 0
    cells.write_cells(vectors.where("false"), path, "tenant_id")
    assert cells.search_cells(spark, path, asked, 3, "tenant_id").found.count() == 0
