"""Presents the given star-schema tables as the five clinical tables.

This is the only module that knows the test tables. Values that the source tables do not hold
(gender, birthdate, stop, deathdate, vital names, planted provider defects) are invented here by
fixed rules on the keys. ``CTES`` states the same rules once more for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encounter class by the digit that starts the order priority.
CLASS_BY_PRIORITY = {"1": "emergency", "2": "inpatient", "3": "outpatient", "4": "ambulatory", "5": "wellness"}

# Vital sign by line number modulo 3.
VITAL_BY_LINE = {0: "Systolic Blood Pressure", 1: "Diastolic Blood Pressure", 2: "Heart rate"}

# Departments by nation key modulo 8.
DEPARTMENTS = [
    "Cardiology",
    "Neurology",
    "Oncology",
    "Pediatrics",
    "Orthopedics",
    "Emergency Medicine",
    "Radiology",
    "General Surgery",
]

# Condition vocabularies of the stand-in data (the p_type values).
PREVALENCE_CONDITIONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
COMORBIDITIES = {
    "cmb_economy": "ECONOMY",
    "cmb_large": "LARGE",
    "cmb_medium": "MEDIUM",
    "cmb_promo": "PROMO",
    "cmb_small": "SMALL",
    "cmb_standard": "STANDARD",
}
VITALS = {
    "vit_systolic": "Systolic Blood Pressure",
    "vit_diastolic": "Diastolic Blood Pressure",
    "vit_heart_rate": "Heart rate",
}

AS_OF = "2001-09-15"


def _case(subject: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in mapping.items()
    )
    return f"CASE {subject} {whens} END"


_CLASS_SQL = _case("substr(o_orderpriority, 1, 1)", CLASS_BY_PRIORITY)
_VITAL_SQL = _case("l_linenumber % 3", VITAL_BY_LINE)
_DEPARTMENT_SQL = _case("s_nationkey % 8", dict(enumerate(DEPARTMENTS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS patient",
        "o_orderdate AS start",
        "o_orderdate + make_dt_interval(CAST(o_orderkey % 14 AS INT)) AS stop",
        f"{_CLASS_SQL} AS encounterclass",
        "o_orderstatus AS payer",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS total_claim_cost",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.75 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS payer_coverage",
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    last_stop = (
        encounters(spark, sf_dir).groupBy(F.col("patient").alias("last_patient")).agg(F.max("stop").alias("last_stop"))
    )
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(last_stop, (F.col("c_custkey") == F.col("last_patient")) & (F.col("c_acctbal") < 0), "left")
        .selectExpr(
            "c_custkey AS id",
            "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "c_mktsegment AS race",
            "n_name AS state",
            "date_add(DATE '1930-01-01', CAST(c_custkey * 37 % 22000 AS INT)) AS birthdate",
            "date_add(CAST(last_stop AS DATE), CAST(c_custkey % 60 AS INT)) AS deathdate",
            "CAST(c_acctbal AS DECIMAL(18,2)) AS income",
        )
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_returnflag <> 'N'").selectExpr(
        "l_orderkey AS encounter",
        "o_custkey AS patient",
        "l_partkey AS code",
        "p_type AS description",
        "CAST(l_shipdate AS DATE) AS start",
    )


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "l_returnflag = 'N'").selectExpr(
        "l_orderkey AS encounter",
        "o_custkey AS patient",
        "l_partkey AS code",
        "p_type AS description",
        "l_shipdate AS start",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS base_cost",
    )


def _lines(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(keep)
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS encounter",
        f"{_VITAL_SQL} AS description",
        "CASE WHEN l_linenumber = 7 THEN 'not recorded' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value",
        "l_shipdate AS date",
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider table with planted defects: missing and misspelt departments, NULL and low volumes."""
    lines = table(spark, sf_dir, "lineitem")
    seen = lines.groupBy("l_suppkey").agg(
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.count("*").alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
    )
    rates = lines.agg(
        F.struct(
            (F.count_if(F.col("l_returnflag") == "R").cast("double") / F.count("*")).alias("r"),
            (F.count_if(F.col("l_returnflag") == "A").cast("double") / F.count("*")).alias("a"),
        ).alias("rates")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(seen, F.col("s_suppkey") == F.col("l_suppkey"))
        .withColumn("rates", rates.scalar())
        .withColumn("dept", F.expr(_DEPARTMENT_SQL))
        .selectExpr(
            "s_suppkey AS doctor_id",
            "s_name AS doctor_name",
            """CASE WHEN s_suppkey % 29 = 3 THEN NULL
                    WHEN s_suppkey % 23 = 7 THEN concat(substr(dept, 1, 2), substr(dept, 4))
                    WHEN s_suppkey % 5 = 0 THEN concat(' ', upper(dept), ' ')
                    ELSE dept END AS department_raw""",
            "CASE WHEN s_suppkey % 29 = 3 THEN 'Unassigned' ELSE dept END AS department",
            """CASE WHEN s_suppkey % 19 = 5 THEN NULL
                    WHEN s_suppkey % 13 = 4 THEN n_orders % 30
                    ELSE n_orders END AS encounters""",
            "CASE WHEN s_suppkey % 31 = 6 THEN NULL ELSE n_r END AS mortality_count",
            "rates.r * n_lines * (0.6D + (s_suppkey * 37 % 100) / 100.0D) AS expected_mortality",
            "n_a AS readmission_count",
            """CASE WHEN s_suppkey % 37 = 9 THEN 0.0D
                    ELSE rates.a * n_lines * (0.6D + (s_suppkey * 53 % 100) / 100.0D) END AS expected_readmission""",
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with a title that is sometimes missing and sometimes the literal 'None'."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS doc_id",
        "source",
        "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'None' "
        "ELSE concat(lang, ' guideline ', doc_id) END AS title",
        "concat('doc://', source, '/', doc_id) AS url",
        "text",
        "lang",
    )


# Text (bronze) form of the clinical tables, valid in both engines. Some values are planted as unreadable.
BRONZE = {
    "patients": [
        "CAST(id AS STRING) AS id",
        "CASE WHEN id % 50 = 7 THEN '2020-13-01' ELSE CAST(birthdate AS STRING) END AS birthdate",
        "CAST(deathdate AS STRING) AS deathdate",
        "CASE id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'S' ELSE 'D' END AS marital",
        "race",
        "CASE id % 2 WHEN 0 THEN 'hispanic' ELSE 'nonhispanic' END AS ethnicity",
        "gender",
        "concat('City ', id % 40) AS city",
        "state",
        "concat('County ', id % 12) AS county",
        "lpad(CAST(id % 100000 AS STRING), 5, '0') AS zip",
        "CASE WHEN id % 45 = 9 THEN 'abc' ELSE CAST(income AS STRING) END AS healthcare_expenses",
        "CASE WHEN id % 45 = 11 THEN '' ELSE CAST(income AS STRING) END AS healthcare_coverage",
        "CAST(income AS STRING) AS income",
    ],
    "encounters": [
        "CAST(id AS STRING) AS id",
        "CASE WHEN id % 60 = 13 THEN 'soon' ELSE CAST(start AS STRING) END AS start",
        "CAST(stop AS STRING) AS stop",
        "CAST(patient AS STRING) AS patient",
        "concat('org ', id % 9) AS organization",
        "payer",
        "encounterclass",
        "CAST(id % 500 AS STRING) AS code",
        "concat('visit ', id % 500) AS description",
        "CAST(total_claim_cost AS STRING) AS base_encounter_cost",
        "CASE WHEN id % 70 = 21 THEN 'n/a' ELSE CAST(total_claim_cost AS STRING) END AS total_claim_cost",
        "CAST(CAST(payer_coverage AS DECIMAL(18,2)) AS STRING) AS payer_coverage",
        "CAST(id % 7 AS STRING) AS reasoncode",
        "concat('reason ', id % 7) AS reasondescription",
    ],
    "conditions": [
        "CASE WHEN code % 33 = 5 THEN 'unknown' ELSE CAST(start AS STRING) END AS start",
        "CAST(start AS STRING) AS stop",
        "CAST(patient AS STRING) AS patient",
        "CAST(encounter AS STRING) AS encounter",
        "'snomed' AS system",
        "CAST(code AS STRING) AS code",
        "description",
    ],
    "observations": [
        "CAST(date AS STRING) AS date",
        "CAST(encounter % 1500 AS STRING) AS patient",
        "CAST(encounter AS STRING) AS encounter",
        "'vital-signs' AS category",
        "CAST(encounter % 3 AS STRING) AS code",
        "description",
        "value",
        "'mmHg' AS units",
        "'numeric' AS type",
    ],
    "procedures": [
        "CAST(start AS STRING) AS start",
        "CAST(start AS STRING) AS stop",
        "CAST(patient AS STRING) AS patient",
        "CAST(encounter AS STRING) AS encounter",
        "'snomed' AS system",
        "CAST(code AS STRING) AS code",
        "description",
        "CASE WHEN code % 51 = 8 THEN '12,5' ELSE CAST(base_cost AS STRING) END AS base_cost",
        "CAST(code % 7 AS STRING) AS reasoncode",
        "concat('reason ', code % 7) AS reasondescription",
    ],
}


def bronze(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    typed = {
        "patients": patients,
        "encounters": encounters,
        "conditions": conditions,
        "observations": observations,
        "procedures": procedures,
    }[name]
    return typed(spark, sf_dir).selectExpr(*BRONZE[name])


# The same rules as SQL for the check engine. Each entry may use the entries named in DEPENDS.
CTES = {
    "encounters": f"""
        SELECT o_orderkey AS id, o_custkey AS patient, o_orderdate AS start,
               o_orderdate + to_days(CAST(o_orderkey % 14 AS INTEGER)) AS stop,
               {_CLASS_SQL} AS encounterclass, o_orderstatus AS payer,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_claim_cost,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.75 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS payer_coverage
        FROM orders""",
    "patients": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               c_mktsegment AS race, n_name AS state,
               DATE '1930-01-01' + CAST(c_custkey * 37 % 22000 AS INTEGER) AS birthdate,
               CASE WHEN c_acctbal < 0 THEN CAST(last_stop AS DATE) + CAST(c_custkey % 60 AS INTEGER) END AS deathdate,
               CAST(c_acctbal AS DECIMAL(18,2)) AS income
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT patient, max(stop) AS last_stop FROM encounters GROUP BY patient) s ON s.patient = c_custkey""",
    "conditions": """
        SELECT l_orderkey AS encounter, o_custkey AS patient, l_partkey AS code, p_type AS description,
               CAST(l_shipdate AS DATE) AS start
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag <> 'N'""",
    "procedures": """
        SELECT l_orderkey AS encounter, o_custkey AS patient, l_partkey AS code, p_type AS description,
               l_shipdate AS start, CAST(l_extendedprice AS DECIMAL(18,2)) AS base_cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'N'""",
    "observations": f"""
        SELECT l_orderkey AS encounter, {_VITAL_SQL} AS description,
               CASE WHEN l_linenumber = 7 THEN 'not recorded'
                    ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS value,
               l_shipdate AS date
        FROM lineitem""",
    "providers": f"""
        SELECT s_suppkey AS doctor_id, s_name AS doctor_name,
               CASE WHEN s_suppkey % 29 = 3 THEN 'Unassigned' ELSE {_DEPARTMENT_SQL} END AS department,
               CASE WHEN s_suppkey % 19 = 5 THEN NULL
                    WHEN s_suppkey % 13 = 4 THEN n_orders % 30 ELSE n_orders END AS encounters,
               CASE WHEN s_suppkey % 31 = 6 THEN NULL ELSE n_r END AS mortality_count,
               r * n_lines * (CAST(0.6 AS DOUBLE) + CAST(s_suppkey * 37 % 100 AS DOUBLE) / 100.0) AS expected_mortality,
               n_a AS readmission_count,
               CASE WHEN s_suppkey % 37 = 9 THEN 0.0 ELSE
               a * n_lines * (CAST(0.6 AS DOUBLE) + CAST(s_suppkey * 53 % 100 AS DOUBLE) / 100.0) END AS expected_readmission
        FROM supplier
        JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_lines,
                     count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag = 'A') AS n_a
              FROM lineitem GROUP BY l_suppkey) s ON l_suppkey = s_suppkey
        CROSS JOIN (SELECT CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS r,
                           CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) / count(*) AS a FROM lineitem) g""",
    "corpus": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, source,
               CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'None'
                    ELSE concat(lang, ' guideline ', doc_id) END AS title,
               concat('doc://', source, '/', doc_id) AS url, text, lang
        FROM documents""",
}
for _name, _columns in BRONZE.items():
    CTES[f"bronze_{_name}"] = f"SELECT {', '.join(_columns)} FROM {_name}"
DEPENDS = {"patients": ["encounters"], "bronze_patients": ["patients"], **{
    f"bronze_{n}": [n] for n in ("encounters", "conditions", "observations", "procedures")
}}


def with_ctes(names: str, body: str) -> str:
    """``body`` preceded by the named tables (space separated) and whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    listed = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {listed},\n{body[5:]}"
    return f"WITH {listed}\n{body}"
