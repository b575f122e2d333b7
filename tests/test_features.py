import datetime as dt
import random

from pyspark.sql import functions as F

from wardlake.operators import features as ops

T0 = dt.datetime(2020, 1, 1)
ENC = "id int, patient string, start timestamp_ntz, stop timestamp_ntz, encounterclass string, total_claim_cost decimal(18,2)"
PAT = "id string, gender string, birthdate date, deathdate date"
CON = "patient string, code string, description string, start date"


def frames(spark, enc, pat, con):
    return (
        spark.createDataFrame([(*e, 10) if len(e) == 5 else e for e in enc], ENC.replace("decimal(18,2)", "int")),
        spark.createDataFrame(pat, PAT),
        spark.createDataFrame(con, CON),
    )


def brute(enc, pat, con):
    month = dt.timedelta(days=30)
    out = {}
    for i, p, start, stop, kind in enc:
        if kind != "inpatient":
            continue
        own = [e for e in enc if e[1] == p]
        stays = sorted((e[2], e[0]) for e in own if e[4] == "inpatient")
        at = stays.index((start, i))
        nxt = stays[at + 1][0] if at + 1 < len(stays) else None
        before = [e[2] for e in own if e[2] < start]
        death = {q[0]: q[3] for q in pat}[p]
        readmit = nxt is not None and nxt - stop <= month
        died = death is not None and 0 <= (death - stop.date()).days <= 30
        soon = any(e[4] == "emergency" and stop < e[2] <= stop + month for e in own)
        out[i] = (
            at,
            len({c[1] for c in con if c[0] == p and c[3] <= start.date()}),
            sum(e[4] == "emergency" and e[2] < start for e in own),
            (start - max(before)).days if before else 0,
            int(readmit),
            int(died),
            int(readmit or died or soon),
        )
    return out


COLUMNS = [
    "prior_encounters", "prior_conditions_count", "prior_emergency_visits", "days_since_last_encounter",
    "readmission", "mortality", "deterioration",
]


def result(spark, enc, pat, con):
    base = ops.inpatient_base(*frames(spark, enc, pat, con))
    return {r["encounter_id"]: tuple(r[c] for c in COLUMNS) for r in base.collect()}


def test_history_matches_brute_force(spark):
    rng = random.Random(11)
    enc, con = [], []
    for i in range(700):
        p = "hot" if i % 3 == 0 else f"p{rng.randrange(12)}"
        start = T0 + dt.timedelta(hours=rng.randrange(0, 24 * 200, 6))
        stop = start + dt.timedelta(hours=rng.randrange(0, 240, 12))
        enc.append((i, p, start, stop, rng.choice(["inpatient", "emergency", "wellness"])))
        con.append((p, f"c{rng.randrange(30)}", "x", (start + dt.timedelta(days=rng.randrange(-3, 3))).date()))
    pat = [(p, "F", dt.date(1960, 2, 29), rng.choice([None, dt.date(2020, 4, 1)])) for p in ["hot", *[f"p{i}" for i in range(12)]]]
    assert result(spark, enc, pat, con) == brute(enc, pat, con)


def test_edges(spark):
    day = dt.timedelta(days=1)
    enc = [
        (1, "tie", T0, T0 + day, "inpatient"),
        (2, "tie", T0, T0 + 2 * day, "inpatient"),
        (3, "overlap", T0, T0 + 10 * day, "inpatient"),
        (4, "overlap", T0 + 5 * day, T0 + 6 * day, "inpatient"),
        (5, "exact", T0, T0 + day, "inpatient"),
        (6, "exact", T0 + 31 * day, T0 + 32 * day, "inpatient"),
        (7, "late", T0, T0 + day, "inpatient"),
        (8, "late", T0 + 31 * day + dt.timedelta(microseconds=1), T0 + 32 * day, "inpatient"),
        (9, "er", T0, T0 + day, "inpatient"),
        (10, "er", T0, T0, "emergency"),
        (11, "er", T0 + day, T0 + day, "emergency"),
        (12, "d0", T0, T0 + day, "inpatient"),
        (13, "d30", T0, T0 + day, "inpatient"),
        (14, "d31", T0, T0 + day, "inpatient"),
        (15, "dm1", T0, T0 + day, "inpatient"),
    ]
    death = {"d0": 1, "d30": 31, "d31": 32, "dm1": 0}
    pat = [
        (p, "M", dt.date(2000, 2, 29), (T0 + death[p] * day).date() if p in death else None)
        for p in dict.fromkeys(e[1] for e in enc)
    ]
    con = [("tie", "a", "x", T0.date()), ("tie", "a", "x", T0.date() - day), ("tie", "b", "x", T0.date() + day)]
    got = result(spark, enc, pat, con)
    assert got == brute(enc, pat, con)
    assert [got[i][4] for i in (1, 3, 5, 7)] == [1, 1, 1, 0]
    assert [got[i][5] for i in (12, 13, 14, 15)] == [1, 1, 0, 0]
    assert got[9][2] == 0 and got[9][6] == 0  # emergencies at the same instants count neither before nor after
    assert got[1][1] == 1


def test_time_safety_and_plan(spark):
    enc = [(i, "p", T0 + dt.timedelta(days=7 * i), T0 + dt.timedelta(days=7 * i + 2), ["inpatient", "emergency"][i % 2]) for i in range(20)]
    pat = [("p", "F", dt.date(1950, 1, 1), None)]
    con = [("p", f"c{i}", "x", (T0 + dt.timedelta(days=9 * i)).date()) for i in range(15)]
    whole = result(spark, enc, pat, con)
    cut = 10
    past = result(spark, [e for e in enc if e[0] <= cut], pat, [c for c in con if c[3] <= enc[cut][2].date()])
    for i in past:
        assert past[i][:4] == whole[i][:4]
    plan = ops.inpatient_base(*frames(spark, enc, pat, con))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan and "InPandas" not in plan


def test_medians_and_flags(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0), (4, 2.0)], "id int, v double")
    out = {r["id"]: (r["v"], r["v_missing"]) for r in ops.feature_matrix(df, ["v"]).collect()}
    assert out == {1: (1.0, 0), 2: (2.0, 1), 3: (4.0, 0), 4: (2.0, 0)}
    costs = spark.createDataFrame([(float(i),) for i in range(1, 6)], "total_claim_cost double")
    assert [r["high_cost"] for r in ops.high_cost(costs).orderBy("total_claim_cost").collect()] == [0, 0, 0, 1, 1]
    fitted = ops.high_cost(costs, fit_on=costs.where(F.col("total_claim_cost") < 3))
    assert sum(r["high_cost"] for r in fitted.collect()) == 4


def test_vitals_ignore_text_and_flags_are_time_safe(spark):
    obs = spark.createDataFrame([(1, "BP", "120"), (1, "BP", "n/a"), (1, "BP", "130"), (2, "BP", "x")], "encounter int, description string, value string")
    means = {r["encounter"]: r["bp"] for r in ops.mean_vitals(obs, {"bp": "BP"}).collect()}
    assert means == {1: 125.0, 2: None}
    stays = spark.createDataFrame([(1, "p", T0), (2, "q", T0)], "encounter_id int, patient string, start timestamp_ntz")
    con = spark.createDataFrame([("p", "c", "HTN", T0.date()), ("q", "c", "HTN", T0.date() + dt.timedelta(days=1))], CON)
    flags = {r["encounter_id"]: r["htn"] for r in ops.comorbidity_flags(stays, con, {"htn": "HTN"}).collect()}
    assert flags == {1: 1, 2: 0}
    assert "total_claim_cost" not in ops.feature_columns("high_cost", ["htn"], ["bp"])
    assert "total_claim_cost" in ops.feature_columns("readmission", ["htn"], ["bp"])
