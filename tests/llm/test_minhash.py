import itertools
import random
import re

import numpy as np
import pytest

from wardlake.llm import minhash as m
from wardlake.llm.joins import components

DOCS = "doc_id bigint, text string, component_id string, node int"


def shingles(text, k):
    lowered = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        one, other = rows[i][0], rows[j][0]
        if one is not None and other is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(one), find(other)))
            parent[y] = x
    out = []
    for (doc, _), own in zip(rows, sets):
        root = None if doc is None else find(doc)
        out.append((doc, len(own), root, doc is None or root == doc))
    return sorted(out, key=repr)


def check(spark, rows, k=4):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(4)
    got = sorted((tuple(r) for r in m.near_duplicates(frame, k).collect()), key=repr)
    assert got == expected(rows, k)
    return frame


def family(rng, base, n, edits, first):
    rows = []
    for i in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
        rows.append((first + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_NODES", block)
    rng = random.Random(18)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst")
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)]
    shared = text(80)
    rows += [(100 + i, f"{text(30)} {shared} {text(20)}") for i in range(40)]  # a common passage, no duplicates
    rows += family(rng, text(150), 60, 6, 300)  # a chain of near copies around the threshold
    rows += family(rng, text(30), 40, 1, 500)
    rows += [(700 + i, shared) for i in range(30)]
    rows += [(800, None), (801, ""), (802, " \n\t"), (803, "one two"), (804, "ONE\ttwo"), (805, "one two three"), (806, "a b c d e f g h"), (807, "a b c d e f g")]
    rows += [(808, "long text " + "w x y z " * 40_000), (809, "long text " + "w x y z " * 40_001)]
    rows += [(None, shared), (None, "one two"), (-5, "one two"), (700, shared)]
    frame = check(spark, rows)
    if block == 4:
        kept = m.clean_documents(frame, 4)
        assert kept.columns == frame.columns
        want = {d for d, _, _, k in expected(rows, 4) if k}
        assert {r.doc_id for r in kept.collect()} == want


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x y z w v"), (3, "a b c d")])


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (20, 20), (30, 31), (31, 30), *((100, 100 + i) for i in range(1, 50)), (149, 99)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 6)) and {got[10], got[11], got[12]} == {10} and got[31] == 30
    assert all(got[i] == 99 for i in range(99, 150)) and 20 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(19)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2700], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    same = [(m.minima(a[: 10 * i]) == m.minima(b[: 10 * i])).mean() for i in (20, 300)]
    assert same[0] == 1.0 and abs(same[1] - 2700 / 3300) < 0.15
