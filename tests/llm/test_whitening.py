import math

import numpy as np
import pytest

from wardlake.llm import queries
from wardlake.llm import whitening as w

ROWS = "vec_id bigint, embedding array<double>, q string, n int"


def expected(rows, k=16):
    """Plain numpy: ids, deviations in exact integers, whitened values up to their sign."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) <= w.MAX_ENTRY for c in v)]
    if not kept:
        return None
    lengths = [len(v) for _, v in kept]
    d = max(lengths, key=lambda x: (lengths.count(x), x))
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in kept if len(v) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept]
    x = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    cov = x.T @ x / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-9 * max(values.max(), 1e-300)).sum())
    k = min(k, rank)
    centred = np.array([[c - s / n for c, s in zip(row, sums)] for _, row in kept])
    return kept, n, deviations, values[:k], values[:k] / cov.trace() if k else [], centred @ vectors[:, :k] / np.sqrt(values[:k])


def check(frame, rows, k=16, simple=True):
    got = sorted(map(tuple, w.judged(frame, k).collect()), key=repr)
    want = expected(rows, k)
    if want is None or not len(want[3]):
        assert got == []
        return got
    kept, n, deviations, values, explained, white = want
    assert len(got) == len(kept) * len(values) and {r[2] for r in got} == {n}
    by_id = {}
    for i, component, _, deviation, value, share, error in got:
        assert abs(share - explained[component - 1]) <= 1e-9 and error < 1e-9
        by_id.setdefault(i, {}).setdefault(component, []).append((value, deviation))
    for (i, _), deviation, row in zip(kept, deviations, white):
        found = by_id[i]
        assert sorted(found) == list(range(1, len(values) + 1))
        assert all(d == (deviation if deviation < 2**63 else None) for own in found.values() for _, d in own) or i in (None, 3)
        if simple and i not in (None, 3):
            assert np.allclose([abs(found[c][0][0]) for c in sorted(found)], abs(row), atol=1e-7)
    signs = [np.sign([by_id[i][c + 1][0][0] * row[c] for (i, _), row in zip(kept, white) if i not in (None, 3) and abs(row[c]) > 1e-6]) for c in range(len(values))]
    assert not simple or all(len(set(s)) <= 1 for s in signs)
    return got


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)


def test_against_numpy_with_awkward_rows(spark):
    rng = np.random.default_rng(2)
    scale = np.geomspace(3, 0.2, 20)
    rows = [(100 + i, [float(c) for c in rng.normal(0, 1, 20) * scale + 1]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    rows += [(1, None), (2, [float("nan")] * 20), (4, [float("inf")] * 20), (5, [None] * 20), (6, []), (7, [1.0, 2.0])]
    rows += [(3, rows[1][1]), (3, rows[2][1]), (None, rows[3][1])]
    check(frame_of(spark, rows), rows)


def test_few_rows_and_equal_components(spark):
    check(frame_of(spark, []), [])
    one = [(8, [1.0, 2.0])]
    check(frame_of(spark, one * 3), one * 3)
    line = [(10 + i, [i / 7, -i / 7, 5.0]) for i in range(9)]
    check(frame_of(spark, line), line)
    # a square has two equal components: any pair of axes will do
    square = [(20 + i, [x, y, 0.0]) for i, (x, y) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])]
    got = check(frame_of(spark, square), square, simple=False)
    assert len(got) == 8


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(100 + i, [float(c) for c in rng.integers(-(2**33), 2**33, 3)]) for i in range(40)]
    check(frame_of(spark, rows), rows)
    q = rng.integers(-(2**40), 2**40, (50, 4))
    assert w._block_products(q).tolist() == [[sum(int(a) * int(b) for a, b in zip(q[:, i], q[:, j])) for j in range(4)] for i in range(4)]


@pytest.mark.parametrize("table", ["sf0.001"])
def test_query_on_the_given_table(spark, table):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in queries.table(spark, f"/root/testdata/{table}", "embeddings").collect()]
    kept, n, deviations, values, explained, white = expected(rows)
    got = queries.QUERIES["op11_whiten"](spark, f"/root/testdata/{table}").collect()
    assert len(got) == len(rows) * 16
    found = {(r.vec_id, r.component): r for r in got}
    for (i, _), deviation, row in zip(kept, deviations, white):
        assert found[i, 1].deviation == deviation and found[i, 1].n == n
        assert np.allclose([abs(found[i, c + 1].whitened) for c in range(16)], abs(row), atol=1e-8)
    assert np.allclose([found[0, c + 1].explained for c in range(16)], explained, rtol=1e-9)
    assert 0 <= got[0].identity_error < 1e-9
