"""Registered queries: provider scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.clinical import with_ctes
from wardlake.operators import scorecard as ops
from wardlake.plans.registry import query

SQL_SUPPRESSED = {
    "mortality": "(coalesce(encounters < 30, false) OR mortality_count IS NULL OR expected_mortality IS NULL OR expected_mortality <= 0)",
    "readmission": "(coalesce(encounters < 30, false) OR readmission_count IS NULL OR expected_readmission IS NULL OR expected_readmission <= 0)",
}
SQL_SCORED = f"""scored AS (SELECT *, {SQL_SUPPRESSED['mortality']} AS suppressed_mortality,
    {SQL_SUPPRESSED['readmission']} AS suppressed_readmission,
    CASE WHEN NOT {SQL_SUPPRESSED['mortality']} THEN CAST(CAST(mortality_count / expected_mortality AS DECIMAL(18,2)) AS DOUBLE) END AS oe_mortality,
    CASE WHEN NOT {SQL_SUPPRESSED['readmission']} THEN CAST(CAST(readmission_count / expected_readmission AS DECIMAL(18,2)) AS DOUBLE) END AS oe_readmission
    FROM providers)"""


def sql_pooled(outcome="mortality"):
    total = f"CAST(sum(CAST(expected_{outcome} AS DECIMAL(28,10))) AS DOUBLE)"
    return f"CASE WHEN {total} > 0 THEN CAST(sum({outcome}_count) AS DOUBLE) / {total} END"


def cents(expr):
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS DOUBLE)"


SQL_RANK = f"""ranked AS (SELECT department, {cents(sql_pooled())} AS oe FROM scored WHERE department <> 'Unassigned' GROUP BY 1)"""


def scored_of(spark, d):
    return ops.provider_oe(C.providers(spark, d).drop("department_raw"))


def check(body):
    return with_ctes("providers", f"WITH {SQL_SCORED}{body}" if body.startswith(",") else f"WITH {SQL_SCORED} {body}")


@query(
    "provider_oe",
    check(
        "SELECT doctor_id, department, encounters, suppressed_mortality, suppressed_readmission, oe_mortality, oe_readmission FROM scored"
    ),
)
def provider_oe(spark, d):
    return scored_of(spark, d).select(
        "doctor_id", "department", "encounters", "suppressed_mortality", "suppressed_readmission", "oe_mortality", "oe_readmission"
    )


@query(
    "department_summary",
    check(
        f"""SELECT department, count(*) AS doctors, CAST(coalesce(sum(encounters), 0) AS BIGINT) AS encounters,
            {cents(sql_pooled())} AS oe FROM scored GROUP BY 1"""
    ),
)
def department_summary(spark, d):
    return ops.department_summary(scored_of(spark, d))


@query("department_oe_rank", check(f", {SQL_RANK} SELECT * FROM ranked WHERE oe IS NOT NULL"))
def department_oe_rank(spark, d):
    return ops.department_oe_rank(scored_of(spark, d))


@query(
    "hospital_oe",
    check(
        f"""SELECT oe, CASE WHEN oe < 1.0 THEN 'better than' WHEN oe <= 1.02 THEN 'about as' ELSE 'worse than' END AS wording
            FROM (SELECT {sql_pooled()} AS oe FROM scored)"""
    ),
)
def hospital_oe(spark, d):
    return ops.hospital_oe(scored_of(spark, d))


@query(
    "cluster_flag",
    check(
        f""", {SQL_RANK} SELECT department, count(oe_mortality) AS scored, count(*) FILTER (oe_mortality > 1.25) AS above
            FROM scored WHERE department <> (SELECT department FROM ranked WHERE oe IS NOT NULL ORDER BY oe, department LIMIT 1)
            GROUP BY 1 HAVING count(oe_mortality) >= 5
            AND count(*) FILTER (oe_mortality > 1.25) / count(oe_mortality) > CAST(0.20 AS DOUBLE)"""
    ),
)
def cluster_flag(spark, d):
    return ops.cluster_flag(scored_of(spark, d))


SQL_BUCKET = """CASE WHEN oe_mortality IS NULL THEN 'not scored' WHEN oe_mortality < CAST(0.9 AS DOUBLE) THEN 'better'
    WHEN oe_mortality > CAST(1.1 AS DOUBLE) THEN 'review' ELSE 'expected' END"""


@query("provider_bucket", check(f"SELECT department, {SQL_BUCKET} AS bucket, count(*) AS n FROM scored GROUP BY 1, 2"))
def provider_bucket(spark, d):
    return ops.provider_bucket(scored_of(spark, d))


@query(
    "department_insights",
    check(
        f""", hosp AS (SELECT coalesce({cents(sql_pooled())}, 1.0) AS hospital_oe FROM scored),
        dept AS (SELECT department, count(oe_mortality) AS scored, count(*) FILTER (oe_mortality > CAST(1.1 AS DOUBLE)) AS flagged,
            {sql_pooled()} AS department_oe FROM scored GROUP BY 1),
        lo AS (SELECT department, doctor_name FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY oe_mortality, doctor_id) rn
               FROM scored WHERE oe_mortality IS NOT NULL) WHERE rn = 1),
        hi AS (SELECT department, doctor_name FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY oe_mortality DESC, doctor_id) rn
               FROM scored WHERE oe_mortality IS NOT NULL) WHERE rn = 1)
        SELECT dept.department, dept.scored, flagged, department_oe, lo.doctor_name AS best_provider, hi.doctor_name AS worst_provider,
            100.0::DOUBLE * flagged / dept.scored AS flagged_pct, hospital_oe,
            CASE WHEN department_oe < hospital_oe THEN 'better than' WHEN department_oe > hospital_oe THEN 'worse than'
                 ELSE 'in line with' END AS against_hospital
        FROM dept JOIN lo USING (department) JOIN hi USING (department) CROSS JOIN hosp WHERE dept.scored > 0"""
    ),
)
def department_insights(spark, d):
    return ops.department_insights(scored_of(spark, d))


@query(
    "provider_vs_department",
    check(
        f""", dept AS (SELECT department, CAST(floor(CAST(sum(encounters) AS DOUBLE) / count(encounters)) AS BIGINT) AS department_volume,
            {sql_pooled()} AS department_oe_mortality, {sql_pooled('readmission')} AS department_oe_readmission FROM scored GROUP BY 1)
        SELECT doctor_id, doctor_name, department, encounters, department_volume,
            CASE WHEN encounters >= department_volume THEN 'above average' WHEN encounters < department_volume THEN 'below average' END AS volume_note,
            oe_mortality, department_oe_mortality, oe_readmission, department_oe_readmission, {SQL_BUCKET} AS status
        FROM scored JOIN dept USING (department)"""
    ),
)
def provider_vs_department(spark, d):
    return ops.provider_vs_department(scored_of(spark, d))


@query("department_clean")
def department_clean(spark, d):
    return ops.clean_departments(C.providers(spark, d).drop("department")).select(
        "doctor_id", "department_raw", "department", "department_note"
    )


@query("handling_report")
def handling_report(spark, d):
    cleaned = ops.clean_departments(C.providers(spark, d).drop("department"))
    return ops.handling_report(ops.provider_oe(cleaned))


@query(
    "department_headcount",
    with_ctes(
        "providers",
        """SELECT 'total providers' AS item, count(*) AS n FROM providers
        UNION ALL SELECT 'departments', count(DISTINCT department) FROM providers
        UNION ALL SELECT 'matching surgery', count(*) FROM providers WHERE department ILIKE '%surgery%'
        UNION ALL (SELECT department, count(*) FROM providers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
    ),
)
def department_headcount(spark, d):
    people = C.providers(spark, d)
    matching = ops.headcount_matching(people, "Surgery").select(
        F.lit("matching surgery").alias("item"), F.col("providers").alias("n")
    )
    return ops.headcount(people).unionByName(matching)


@query(
    "provider_directory",
    with_ctes(
        "providers",
        """WITH pages AS (SELECT department, CAST(ceil(count(*) / 500.0) AS BIGINT) AS pages FROM providers GROUP BY 1)
        SELECT department, (doctor_id * 2654435761) % 4294967296 % pages AS page, count(*) AS n_doctors,
            string_agg(doctor_name || ':' || coalesce(encounters, 0), '; ' ORDER BY doctor_id) AS doctors
        FROM providers JOIN pages USING (department) GROUP BY 1, 2""",
    ),
)
def provider_directory(spark, d):
    listed = F.transform("doctors", lambda x: F.concat(x.doctor_name, F.lit(":"), x.encounters.cast("string")))
    return ops.provider_directory(C.providers(spark, d)).select(
        "department", "page", F.size("doctors").cast("bigint").alias("n_doctors"), F.array_join(listed, "; ").alias("doctors")
    )
