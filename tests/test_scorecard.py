import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from wardlake.operators import scorecard as ops

SCHEMA = (
    "doctor_id long, doctor_name string, department string, encounters long, mortality_count long, "
    "expected_mortality double, readmission_count long, expected_readmission double"
)


def provider(i, dept="A", vol=100, obs=10, exp=10.0):
    return (i, f"d{i}", dept, vol, obs, exp, 5, 5.0)


def scored(spark, rows):
    return ops.provider_oe(spark.createDataFrame(rows, SCHEMA))


def test_suppression(spark):
    rows = [
        provider(1, vol=29), provider(2, vol=30), provider(3, vol=None), provider(4, obs=None),
        provider(5, exp=0.0), provider(6, exp=None), provider(7, obs=12),
    ]
    got = {r["doctor_id"]: (r["oe_mortality"], r["suppressed_mortality"]) for r in scored(spark, rows).collect()}
    assert got == {
        1: (None, True), 2: (1.0, False), 3: (1.0, False), 4: (None, True), 5: (None, True), 6: (None, True), 7: (1.2, False),
    }


def test_hospital_wording_and_buckets(spark):
    for obs, word in ((9, "better than"), (10, "about as"), (11, "worse than")):
        assert ops.hospital_oe(scored(spark, [provider(1, obs=obs)])).first()["wording"] == word
    rows = [provider(1, obs=8), provider(2, obs=9), provider(3, obs=11), provider(4, obs=12), provider(5, vol=1)]
    got = {r["bucket"]: r["n"] for r in ops.provider_bucket(scored(spark, rows)).collect()}
    assert got == {"better": 1, "expected": 2, "review": 1, "not scored": 1}


def test_cluster_needs_five_scored_and_is_not_the_best(spark):
    rows = [provider(i, "Good", obs=1) for i in range(6)]
    rows += [provider(10 + i, "Four", obs=20) for i in range(4)]
    rows += [provider(20 + i, "Five", obs=20 if i < 2 else 10) for i in range(5)]
    rows += [provider(30 + i, "Edge", obs=20 if i < 1 else 10) for i in range(5)]  # exactly 20%
    assert [r["department"] for r in ops.cluster_flag(scored(spark, rows)).collect()] == ["Five"]


def folded(names):
    """The folding rule stated over all pairs."""
    counts = Counter(names)
    out = {}
    for v in counts:
        best = max(
            (
                (difflib.SequenceMatcher(None, c, v).ratio(), c)
                for c in counts
                if c != v and counts[c] >= 5 * counts[v]
            ),
            default=(0, None),
        )
        if best[0] >= 0.85:
            out[v] = best[1]
    return out


def test_fold_matches_all_pairs(spark):
    rng = random.Random(5)
    stems = ["Cardiology", "Neurology", "Oncology", "Emergency Medicine", "Ent", "Icu", "General Surgery", "Aaaaaaaa", "Radiology"]
    names = []
    for stem in stems:
        names += [stem] * rng.randrange(20, 60)
        for _ in range(12):
            s = list(stem)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(s))
                kind = rng.randrange(3)
                if kind == 0 and len(s) > 1:
                    s.pop(at)
                elif kind == 1:
                    s.insert(at, rng.choice("abcx "))
                else:
                    s[at] = rng.choice("aeorz")
            names += ["".join(s)] * rng.randrange(1, 9)
    df = spark.createDataFrame([(n, c) for n, c in Counter(names).items()], "name string, n long")
    got = {r["name"]: r["folded"] for r in ops.fold_map(df).collect()}
    want = folded(names)
    assert len(want) > 20
    assert got == want


def test_clean_departments(spark):
    raw = ["Cardiology"] * 10 + [" CARDIOLOGY "] * 2 + ["Cardology"] * 2 + ["Cardialogy"] * 3 + ["x-ray"] * 1 + [None] * 2
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "doctor_id long, department_raw string")
    out = ops.clean_departments(df).groupBy("department", F.coalesce("department_note", F.lit("-")).alias("note")).count().collect()
    assert {(r["department"], r["note"]): r["count"] for r in out} == {
        ("Cardiology", "-"): 12,
        ("Cardiology", "folded"): 2,  # 12 >= 5 * 2
        ("Cardialogy", "-"): 3,  # 12 < 5 * 3
        ("X-Ray", "-"): 1,
        ("Unassigned", "missing"): 2,
    }


def test_directory_pages_hold_everyone(spark):
    rows = [provider(i, None if i % 9 == 0 else "Hot", vol=None) for i in range(700)]
    pages = ops.provider_directory(spark.createDataFrame(rows, SCHEMA), page_size=50)
    listed = pages.select("department", F.size("doctors").alias("n")).collect()
    assert sum(r["n"] for r in listed) == 700
    assert max(r["n"] for r in listed) < 200
    assert {r["department"] for r in listed} == {"Hot", "Unassigned"}
