import hashlib
import random
import re
from fractions import Fraction

from wardlake.llm import mixing as m

DOCS = "doc_id bigint, text string, source string, size string, target string, taken int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def reshared(sizes, weights, percent, epochs):
    """Targets by resharing in rounds, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = Fraction(percent * sum(sizes.values()), 100), set()
    while True:
        rest = [s for s in names if s not in full]
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > epochs * sizes[s]]
        if not over:
            shares = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            return shares | {s: Fraction(epochs * sizes[s]) for s in full}
        full |= set(over)
        left -= sum(epochs * sizes[s] for s in over)


def check(spark, rows, weights=m.WEIGHTS, percent=m.PERCENT, epochs=m.EPOCHS):
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(4)
    got = [tuple(r) for r in m.mixed(frame, weights, percent, epochs).collect()]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    goals = reshared(sizes, weights, percent, epochs) if sizes else {}
    want = []
    for source, total in sizes.items():
        own = [(hashlib.md5(f"{m.SEED}:{'' if d is None else d}".encode()).hexdigest()[:15], d is not None, d or 0, len(words(t))) for d, t, s in rows if s == source]
        budget, before = int(goals[source]), 0
        for _, known, doc_id, size in sorted(own):
            rest = max(0, min(size, budget % total - before)) if total else 0
            want.append((doc_id if known else None, size, total, float(goals[source]), (budget // total * size if total else 0) + rest))
            before += size
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def corpus(rng, n):
    hot = [(i, "w " * rng.randint(0, 30), "hot") for i in range(n // 2)]
    rest = [(n + i, " \t".join(["a", " b", "c d"][: rng.randint(0, 3)] * 5), f"s{rng.randrange(9)}") for i in range(n // 2)]
    return hot + rest


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = corpus(rng, 400) + [(None, "x y z", None), (None, "x y", None), (7, "long " * 5000, None), (8, None, "é"), (9, "", "é"), (10, "one", "")]
    rows += [(20, "copy of this", "s1")] * 30
    got = check(spark, rows)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    check(spark, rows, (1, 7), 300, 5)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None, None)])
    check(spark, [(1, "a b c", "x")])
    check(spark, [(1, "a b c", "x"), (2, "", "y"), (1, "a b c", "x"), (3, "d", "z")])
    check(spark, [(i, "same words here", "only") for i in range(40)])


def test_mixture_gives_the_planned_words(spark):
    rows = corpus(random.Random(5), 200)
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)
    text = {d: t for d, t, _ in rows}
    plan = {r.doc_id: r.taken for r in m.mixed(frame).collect()}
    taken = {}
    for r in m.mixture(frame).collect():
        assert text[r.doc_id].startswith(r.text) and len(words(r.text)) == r.words > 0
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    assert taken == {d: n for d, n in plan.items() if n}
