"""Registered queries: stay history, targets and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.clinical import with_ctes
from wardlake.operators import features as ops
from wardlake.plans.gold import SQL_AGE
from wardlake.plans.registry import query

TABLES = "encounters patients conditions"
EVERYTHING = "encounters patients conditions observations"
VITALS = list(C.VITALS)
FLAGS = list(C.COMORBIDITIES)

SQL_BASE = f"""
    inpt AS (SELECT id AS encounter_id, patient, start, stop, CAST(total_claim_cost AS DOUBLE) AS total_claim_cost,
        date_diff('second', start, stop) / CAST(86400.0 AS DOUBLE) AS stay_length_days,
        lead(start) OVER (PARTITION BY patient ORDER BY start, id) AS next_start,
        row_number() OVER (PARTITION BY patient ORDER BY start, id) - 1 AS prior_encounters
        FROM encounters WHERE encounterclass = 'inpatient'),
    codes AS (SELECT i.encounter_id, count(DISTINCT c.code) AS n FROM inpt i
        JOIN conditions c ON c.patient = i.patient AND c.start <= CAST(i.start AS DATE) GROUP BY 1),
    emerg AS (SELECT i.encounter_id, count(*) FILTER (e.start < i.start) AS n,
        max((e.start > i.stop AND e.start - i.stop <= INTERVAL 30 DAY)::INT) AS soon
        FROM inpt i JOIN encounters e ON e.patient = i.patient AND e.encounterclass = 'emergency' GROUP BY 1),
    prev AS (SELECT i.encounter_id, max(e.start) AS previous_start FROM inpt i
        JOIN encounters e ON e.patient = i.patient AND e.start < i.start GROUP BY 1),
    base AS (SELECT i.encounter_id, i.patient, i.start, i.stop, p.gender, p.deathdate, i.total_claim_cost,
        i.stay_length_days, i.prior_encounters, {SQL_AGE.format(at="i.start", b="p.birthdate")} AS age,
        coalesce(codes.n, 0) AS prior_conditions_count, coalesce(emerg.n, 0) AS prior_emergency_visits,
        coalesce(CAST(extract(day FROM (i.start - previous_start)) AS BIGINT), 0) AS days_since_last_encounter,
        coalesce((i.next_start - i.stop <= INTERVAL 30 DAY)::INT, 0) AS readmission,
        coalesce((p.deathdate - CAST(i.stop AS DATE) BETWEEN 0 AND 30)::INT, 0) AS mortality,
        coalesce(emerg.soon, 0) AS emergency_soon
        FROM inpt i JOIN patients p ON p.id = i.patient LEFT JOIN codes USING (encounter_id)
        LEFT JOIN emerg USING (encounter_id) LEFT JOIN prev USING (encounter_id))"""

SQL_FLAGS = """
    firsts AS (SELECT patient, {0} FROM conditions GROUP BY patient),
    flags AS (SELECT b.encounter_id, {1} FROM base b LEFT JOIN firsts USING (patient))""".format(
    ", ".join(f"min(start) FILTER (description = '{d}') AS first_{f}" for f, d in C.COMORBIDITIES.items()),
    ", ".join(f"coalesce((first_{f} <= b.start)::INT, 0) AS {f}" for f in FLAGS),
)

SQL_VITALS = """
    means AS (SELECT encounter, {0} FROM observations GROUP BY encounter)""".format(
    ", ".join(
        f"avg(TRY_CAST(value AS DOUBLE)) FILTER (description = '{d}') AS {v}" for v, d in C.VITALS.items()
    )
)

BASE_COLUMNS = (
    "encounter_id, patient, start, stop, gender, total_claim_cost, stay_length_days, prior_encounters, age, "
    "prior_conditions_count, prior_emergency_visits, days_since_last_encounter"
)


def base_of(spark, d):
    return ops.inpatient_base(C.encounters(spark, d), C.patients(spark, d), C.conditions(spark, d))


def assembled_of(spark, d):
    return ops.assemble(
        C.encounters(spark, d),
        C.patients(spark, d),
        C.conditions(spark, d),
        C.observations(spark, d),
        C.COMORBIDITIES,
        C.VITALS,
    )


def stays_of(spark, d):
    return ops.history(C.encounters(spark, d), C.conditions(spark, d)).where(F.col("encounterclass") == "inpatient")


@query("inpatient_base", with_ctes(TABLES, f"WITH {SQL_BASE} SELECT {BASE_COLUMNS} FROM base"))
def inpatient_base(spark, d):
    return base_of(spark, d).select(*[c.strip() for c in BASE_COLUMNS.split(",")])


@query(
    "prior_distinct_count",
    with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, patient, prior_conditions_count FROM base"),
)
def prior_distinct_count(spark, d):
    return stays_of(spark, d).select(F.col("id").alias("encounter_id"), "patient", "prior_conditions_count")


@query(
    "prior_event_count",
    with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, patient, prior_emergency_visits FROM base"),
)
def prior_event_count(spark, d):
    return stays_of(spark, d).select(F.col("id").alias("encounter_id"), "patient", "prior_emergency_visits")


@query(
    "asof_previous",
    with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, patient, days_since_last_encounter FROM base"),
)
def asof_previous(spark, d):
    return stays_of(spark, d).select(
        F.col("id").alias("encounter_id"),
        "patient",
        ops.days_since(F.col("previous_start"), F.col("start")).alias("days_since_last_encounter"),
    )


@query(
    "exists_within_30d",
    with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, patient, CAST(emergency_soon AS BIGINT) AS emergency_soon FROM base"),
)
def exists_within_30d(spark, d):
    visits = C.encounters(spark, d)
    stays = visits.where(F.col("encounterclass") == "inpatient")
    return ops.next_emergency(stays, visits).select(
        F.col("id").alias("encounter_id"),
        "patient",
        ops.emergency_within(F.col("next_emergency"), F.col("stop")).cast("bigint").alias("emergency_soon"),
    )


@query(
    "left_any_flag",
    with_ctes(TABLES, f"WITH {SQL_BASE}, {SQL_FLAGS} SELECT encounter_id, {', '.join(FLAGS)} FROM flags"),
)
def left_any_flag(spark, d):
    stays = C.encounters(spark, d).where(F.col("encounterclass") == "inpatient").select(
        F.col("id").alias("encounter_id"), "patient", "start"
    )
    return ops.comorbidity_flags(stays, C.conditions(spark, d), C.COMORBIDITIES).select("encounter_id", *FLAGS)


@query(
    "lookup_mean",
    with_ctes(
        EVERYTHING,
        f"""WITH {SQL_VITALS} SELECT e.id AS encounter_id, {", ".join(VITALS)} FROM encounters e
            LEFT JOIN means ON encounter = id WHERE encounterclass = 'inpatient'""",
    ),
)
def lookup_mean(spark, d):
    stays = C.encounters(spark, d).where(F.col("encounterclass") == "inpatient").select(F.col("id").alias("encounter_id"))
    return ops.add_vitals(stays, C.observations(spark, d), C.VITALS)


@query("target_readmission", with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, readmission FROM base"))
def target_readmission(spark, d):
    return ops.stay_sequence(C.encounters(spark, d)).select(
        "encounter_id", ops.readmitted(F.col("next_start"), F.col("stop")).cast("int").alias("readmission")
    )


@query("target_mortality", with_ctes(TABLES, f"WITH {SQL_BASE} SELECT encounter_id, mortality FROM base"))
def target_mortality(spark, d):
    people = C.patients(spark, d).select(F.col("id").alias("patient"), "deathdate")
    stays = C.encounters(spark, d).where(F.col("encounterclass") == "inpatient")
    return stays.join(people, "patient").select(
        F.col("id").alias("encounter_id"), ops.died_within(F.col("deathdate"), F.col("stop")).cast("int").alias("mortality")
    )


@query(
    "target_deterioration",
    with_ctes(
        TABLES,
        f"WITH {SQL_BASE} SELECT encounter_id, greatest(readmission, mortality, emergency_soon) AS deterioration FROM base",
    ),
)
def target_deterioration(spark, d):
    return base_of(spark, d).select("encounter_id", "deterioration")


@query(
    "target_high_cost",
    with_ctes(
        "encounters",
        """WITH s AS (SELECT id AS encounter_id, CAST(total_claim_cost AS DOUBLE) AS c FROM encounters
                     WHERE encounterclass = 'inpatient')
           SELECT encounter_id, (c >= (SELECT quantile_cont(c, 0.75) FROM s))::INT AS high_cost FROM s""",
    ),
)
def target_high_cost(spark, d):
    stays = C.encounters(spark, d).where(F.col("encounterclass") == "inpatient").select(
        F.col("id").alias("encounter_id"), F.col("total_claim_cost").cast("double").alias("total_claim_cost")
    )
    return ops.high_cost(stays).select("encounter_id", "high_cost")


@query(
    "feature_matrix",
    with_ctes(
        EVERYTHING,
        f"""WITH {SQL_BASE}, {SQL_FLAGS}, {SQL_VITALS},
        joined AS (SELECT base.*, {", ".join(FLAGS)}, {", ".join(VITALS)} FROM base
            JOIN flags USING (encounter_id) LEFT JOIN means ON encounter = base.encounter_id)
        SELECT encounter_id, age, stay_length_days, prior_encounters, total_claim_cost, prior_conditions_count,
            prior_emergency_visits, days_since_last_encounter,
            {", ".join(f"coalesce({v}, (SELECT quantile_cont({v}, 0.5) FROM joined)) AS {v}" for v in VITALS)},
            {", ".join(f"({v} IS NULL)::INT AS {v}_missing" for v in VITALS)}, {", ".join(FLAGS)}
        FROM joined""",
    ),
)
def feature_matrix(spark, d):
    from wardlake.session import materialize

    frame = materialize(assembled_of(spark, d), "stays")
    matrix = ops.feature_matrix(frame, VITALS)
    return matrix.select("encounter_id", *ops.feature_columns("readmission", FLAGS, VITALS))
