"""Registered queries: sources, layers, typing, quality checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import clinical as C
from wardlake.clinical import with_ctes
from wardlake.operators import quality, selection, typing, uploads
from wardlake.plans.gold import SQL_AGE
from wardlake.plans.registry import query
from wardlake.session import scratch_path
from wardlake.sources import layers, readers


def shown(df):
    """Money as double and dates as timestamps, the types the checks compare."""
    casts = {"decimal": "double", "date": "timestamp_ntz"}
    out = []
    for f in df.schema.fields:
        kind = next((v for k, v in casts.items() if f.dataType.simpleString().split("(")[0] == k), None)
        out.append(F.col(f.name).cast(kind).alias(f.name) if kind else F.col(f.name))
    return df.select(*out)


# --- sources and layers ---------------------------------------------------------------------------


@query("src_csv", with_ctes("bronze_encounters", "SELECT * FROM bronze_encounters"))
def src_csv(spark, d):
    path = scratch_path(spark, "csv")
    readers.write_csv(C.bronze(spark, d, "encounters"), path)
    return readers.read_csv_table(spark, path, typing.KEPT["encounters"])


@query(
    "src_all",
    with_ctes(
        " ".join(f"bronze_{n}" for n in readers.CLINICAL_TABLES),
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS n_rows, {len(C.BRONZE[n])}::BIGINT AS n_columns FROM bronze_{n}"
            for n in readers.CLINICAL_TABLES
        ),
    ),
)
def src_all(spark, d):
    root = scratch_path(spark, "export")
    for name in readers.CLINICAL_TABLES:
        readers.write_csv(C.bronze(spark, d, name), f"{root}/{name}.csv")
    tables = readers.read_tables(spark, {name: f"{root}/{name}.csv" for name in readers.CLINICAL_TABLES})
    counted = [
        t.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(t.columns)).cast("bigint").alias("n_columns")
        )
        for name, t in tables.items()
    ]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


@query(
    "src_upload",
    """SELECT f AS format, event_id, user_id, event_type, value, props, epoch_us(ts) AS ts
       FROM events, (VALUES ('csv'), ('jsonl'), ('parquet')) t(f)""",
)
def src_upload(spark, d):
    events = C.table(spark, d, "events")
    root = scratch_path(spark, "upload")
    readers.write_csv(events, f"{root}/events.csv")
    readers.write_jsonl(events, f"{root}/events.jsonl")
    events.write.parquet(f"{root}/events.parquet")
    out = None
    for kind in ("csv", "jsonl", "parquet"):
        back = readers.read_upload(spark, f"{root}/events.{kind}")
        instant = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
        part = back.select(F.lit(kind).alias("format"), "event_id", "user_id", "event_type", "value", "props", instant)
        out = part if out is None else out.unionByName(part)
    return out


@query("bronze_load", with_ctes("bronze_procedures", "SELECT * FROM bronze_procedures"))
def bronze_load(spark, d):
    root = scratch_path(spark, "lake")
    raw = C.bronze(spark, d, "procedures")
    shouting = raw.toDF(*[c.upper() for c in raw.columns])
    layers.load_bronze(shouting, root, "procedures")
    layers.load_bronze(shouting, root, "procedures")  # a second load replaces the first
    return layers.read_layer(spark, root, "bronze", "procedures").drop("_loaded_at")


SQL_SILVER = {
    "patients": """silver_patients AS (SELECT id, TRY_CAST(birthdate AS DATE) AS birthdate,
        TRY_CAST(deathdate AS DATE) AS deathdate, marital, race, ethnicity, gender, city, state, county, zip,
        TRY_CAST(healthcare_expenses AS DECIMAL(18,2)) AS healthcare_expenses,
        TRY_CAST(healthcare_coverage AS DECIMAL(18,2)) AS healthcare_coverage,
        TRY_CAST(income AS DECIMAL(18,2)) AS income FROM bronze_patients)""",
    "encounters": """silver_encounters AS (SELECT id, TRY_CAST(start AS TIMESTAMP) AS start,
        TRY_CAST(stop AS TIMESTAMP) AS stop, patient, organization, payer, encounterclass, code, description,
        TRY_CAST(base_encounter_cost AS DECIMAL(18,2)) AS base_encounter_cost,
        TRY_CAST(total_claim_cost AS DECIMAL(18,2)) AS total_claim_cost,
        TRY_CAST(payer_coverage AS DECIMAL(18,2)) AS payer_coverage, reasoncode, reasondescription FROM bronze_encounters)""",
    "conditions": """silver_conditions AS (SELECT CAST(TRY_CAST(start AS TIMESTAMP) AS DATE) AS start,
        CAST(TRY_CAST(stop AS TIMESTAMP) AS DATE) AS stop, patient, encounter, system, code, description
        FROM bronze_conditions)""",
    "observations": """silver_observations AS (SELECT TRY_CAST(date AS TIMESTAMP) AS date, patient, encounter, category,
        code, description, value, units, type FROM bronze_observations)""",
    "procedures": """silver_procedures AS (SELECT TRY_CAST(start AS TIMESTAMP) AS start,
        TRY_CAST(stop AS TIMESTAMP) AS stop, patient, encounter, system, code, description,
        TRY_CAST(base_cost AS DECIMAL(18,2)) AS base_cost, reasoncode, reasondescription FROM bronze_procedures)""",
}
_SHOW = {
    "patients": "REPLACE (birthdate::TIMESTAMP AS birthdate, deathdate::TIMESTAMP AS deathdate, "
    "healthcare_expenses::DOUBLE AS healthcare_expenses, healthcare_coverage::DOUBLE AS healthcare_coverage, "
    "income::DOUBLE AS income)",
    "encounters": "REPLACE (base_encounter_cost::DOUBLE AS base_encounter_cost, "
    "total_claim_cost::DOUBLE AS total_claim_cost, payer_coverage::DOUBLE AS payer_coverage)",
    "conditions": "REPLACE (start::TIMESTAMP AS start, stop::TIMESTAMP AS stop)",
    "observations": "",
    "procedures": "REPLACE (base_cost::DOUBLE AS base_cost)",
}


def _register_silver(name):
    sql = f"WITH {SQL_SILVER[name]} SELECT * {_SHOW[name]} FROM silver_{name}"

    @query(f"silver_{name}", with_ctes(f"bronze_{name}", sql))
    def run(spark, d):
        return shown(typing.SILVER[name](C.bronze(spark, d, name)))


for _name in readers.CLINICAL_TABLES:
    _register_silver(_name)


@query(
    "silver_write",
    with_ctes("bronze_conditions", f"WITH {SQL_SILVER['conditions']} SELECT * {_SHOW['conditions']} FROM silver_conditions"),
)
def silver_write(spark, d):
    root = scratch_path(spark, "lake")
    typed = typing.silver_conditions(C.bronze(spark, d, "conditions"))
    layers.write_silver(typed, root, "conditions")
    layers.write_silver(typed, root, "conditions")
    return shown(layers.read_layer(spark, root, "silver", "conditions"))


@query(
    "table_scan",
    with_ctes(
        "bronze_encounters",
        f"""WITH {SQL_SILVER['encounters']} SELECT id, patient, start, total_claim_cost::DOUBLE AS total_claim_cost
            FROM silver_encounters WHERE encounterclass = 'emergency'""",
    ),
)
def table_scan(spark, d):
    root = scratch_path(spark, "lake")
    layers.write_silver(typing.silver_encounters(C.bronze(spark, d, "encounters")), root, "encounters")
    stored = layers.read_layer(spark, root, "silver", "encounters")
    found = selection.filter_by_value(stored, "encounterclass", "emergency")
    return shown(found.select("id", "patient", "start", "total_claim_cost"))


@query(
    "layer_rebuild",
    with_ctes(
        "bronze_patients bronze_encounters bronze_conditions bronze_procedures",
        f"""WITH {SQL_SILVER['patients']}, {SQL_SILVER['encounters']}, {SQL_SILVER['conditions']}, {SQL_SILVER['procedures']},
        enc AS (SELECT patient, count(*) AS n, sum(total_claim_cost) AS c FROM silver_encounters GROUP BY patient),
        cond AS (SELECT patient, count(DISTINCT code) AS n FROM silver_conditions GROUP BY patient),
        prc AS (SELECT patient, count(DISTINCT code) AS n FROM silver_procedures GROUP BY patient)
        SELECT p.id AS patient_id, p.gender, p.race,
           {SQL_AGE.format(at=f"coalesce(p.deathdate, DATE '{C.AS_OF}')", b="p.birthdate")} AS age,
           p.deathdate IS NOT NULL AS deceased, coalesce(enc.n, 0) AS total_encounters,
           coalesce(cond.n, 0) AS distinct_conditions, coalesce(prc.n, 0) AS distinct_procedures,
           coalesce(CAST(enc.c AS DOUBLE), 0.0) AS lifetime_cost
        FROM silver_patients p LEFT JOIN enc ON enc.patient = p.id LEFT JOIN cond ON cond.patient = p.id
        LEFT JOIN prc ON prc.patient = p.id""",
    ),
)
def layer_rebuild(spark, d):
    raw = {name: C.bronze(spark, d, name) for name in readers.CLINICAL_TABLES}
    views = layers.rebuild(spark, raw, scratch_path(spark, "lake"), C.AS_OF, C.PREVALENCE_CONDITIONS)
    return views["patient_360"]


# --- quality --------------------------------------------------------------------------------------

EXPECTED_ROWS = {"patients": 1500, "encounters": 15000, "conditions": 40000, "observations": 60000}


@query(
    "dq_row_counts",
    with_ctes(
        "encounters patients conditions observations",
        "SELECT *, CASE WHEN actual = expected THEN 'OK' ELSE 'MISMATCH' END AS status FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS actual, {e}::BIGINT AS expected"
            for n, e in EXPECTED_ROWS.items()
        )
        + ")",
    ),
)
def dq_row_counts(spark, d):
    tables = {n: getattr(C, n)(spark, d) for n in EXPECTED_ROWS}
    return quality.row_counts(tables, EXPECTED_ROWS)


def silver_patients_of(spark, d):
    return typing.silver_patients(C.bronze(spark, d, "patients"))


_NULLABLE = ["birthdate", "deathdate", "healthcare_expenses", "healthcare_coverage"]


@query(
    "dq_null_pct",
    with_ctes(
        "bronze_patients",
        f"WITH {SQL_SILVER['patients']} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM silver_patients"
            for c in _NULLABLE
        ),
    ),
)
def dq_null_pct(spark, d):
    return quality.null_pct(silver_patients_of(spark, d))


@query(
    "missing_summary",
    with_ctes(
        "bronze_patients",
        f"WITH {SQL_SILVER['patients']} SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, "
            f"100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct FROM silver_patients"
            for c in _NULLABLE
        )
        + ") WHERE missing > 0",
    ),
)
def missing_summary(spark, d):
    return quality.missing_summary(silver_patients_of(spark, d), top=15)


# ships that sail before the order was placed give negative stays, as a planted defect
LINE_RULES = [
    ("lines", "l_quantity", "l_quantity < 5 OR l_quantity > 45", "quantity out of range"),
    ("lines", "l_extendedprice", "l_extendedprice < 0", "negative price"),
    ("lines", "l_shipdate", "l_shipdate < o_orderdate", "negative stay"),
    ("people", "c_acctbal", "c_acctbal < 0", "negative balance"),
    ("people", "c_nationkey", "c_nationkey NOT BETWEEN 0 AND 24", "unknown state"),
]


@query(
    "dq_domain_rules",
    """WITH lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), people AS (SELECT * FROM customer)
    SELECT *, CASE WHEN violations = 0 THEN 'OK' ELSE 'VIOLATED' END AS status FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{text}' AS rule, count(*) FILTER ({cond}) AS violations FROM {t}"
        for t, c, cond, text in LINE_RULES
    )
    + ")",
)
def dq_domain_rules(spark, d):
    lines = C.table(spark, d, "lineitem").join(C.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.domain_rules({"lines": lines, "people": C.table(spark, d, "customer")}, LINE_RULES)


_QUALITY = {"id": "string", "birthdate": "date", "deathdate": "date", "marital": "string", "race": "string",
            "ethnicity": "string", "gender": "string", "city": "string", "state": "string", "county": "string", "zip": "string",
            "healthcare_expenses": "decimal(18,2)", "healthcare_coverage": "decimal(18,2)", "income": "decimal(18,2)"}


@query(
    "dq_column_quality",
    with_ctes(
        "bronze_patients",
        f"WITH {SQL_SILVER['patients']} SELECT *, CASE WHEN missing_pct > 0 THEN 'has missing values' ELSE 'ok' END AS status FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct, "
            f"count(DISTINCT {c}) AS distinct_values FROM silver_patients"
            for c, t in _QUALITY.items()
        )
        + ")",
    ),
)
def dq_column_quality(spark, d):
    return quality.column_quality(silver_patients_of(spark, d))


def rounded(df, columns):
    return df.withColumns({c: F.col(c).cast("decimal(18,6)").cast("double") for c in columns})


def digits(df, columns):
    """Values to eight significant digits."""
    return df.withColumns({c: F.format_string("%.7e", c) for c in columns})


def sql_digits(expr):
    return f"printf('%.7e', {expr})"


_OUTLIER_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "outliers_iqr",
    """WITH v AS (SELECT 'l_quantity' AS c, l_quantity AS x FROM lineitem UNION ALL
                 SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
         q AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY c)
       SELECT c AS column_name, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
         100.0::DOUBLE * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(x) AS outlier_pct,
         min(x) AS min_value, max(x) AS max_value,
         CAST(CAST(q1 - 1.5 * (q3 - q1) AS DECIMAL(18,6)) AS DOUBLE) AS lower_bound,
         CAST(CAST(q3 + 1.5 * (q3 - q1) AS DECIMAL(18,6)) AS DOUBLE) AS upper_bound
       FROM v JOIN q USING (c) GROUP BY c, q1, q3""",
)
def outliers_iqr(spark, d):
    found = quality.outliers_iqr(C.table(spark, d, "lineitem"), _OUTLIER_COLUMNS)
    return rounded(found, ["lower_bound", "upper_bound"])


# limits wide enough that only a few values fall outside at the check scale
_LIMITS = {"c_acctbal": "c_acctbal < -990", "c_nationkey": "c_nationkey > 24", "c_custkey": "c_custkey < 3"}


@query(
    "implausible_values",
    "SELECT c AS column_name, count(x) AS implausible, CASE WHEN count(x) BETWEEN 1 AND 10 "
    "THEN string_agg(CAST(x AS VARCHAR), ', ' ORDER BY x) ELSE '' END AS listed FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, CASE WHEN {cond} THEN CAST({c} AS DECIMAL(18,2)) END AS x FROM customer" for c, cond in _LIMITS.items()
    )
    + ") GROUP BY c",
)
def implausible_values(spark, d):
    return quality.implausible_values(C.table(spark, d, "customer"), _LIMITS)


@query(
    "numeric_profile",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, CAST(min({c}) AS DOUBLE) AS min_value, "
        + ", ".join(
            f"CAST(CAST(quantile_cont({c}, {p}) AS DECIMAL(18,6)) AS DOUBLE) AS {n}"
            for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        )
        + f", CAST(max({c}) AS DOUBLE) AS max_value, {sql_digits(f'avg({c})')} AS mean, {sql_digits(f'stddev_samp({c})')} AS std FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
    + ")",
)
def numeric_profile(spark, d):
    # sums of doubles depend on their order, so the moments are compared to six digits before the point's tie
    profile = quality.numeric_profile(C.table(spark, d, "orders"))
    return digits(rounded(profile, ["q1", "median", "q3"]), ["mean", "std"])


@query(
    "histogram",
    """SELECT CAST(least(29, floor((x - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS n
       FROM (SELECT o_totalprice AS x, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders) GROUP BY 1""",
)
def histogram(spark, d):
    return quality.histogram(C.table(spark, d, "orders"), "o_totalprice", 30)


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    "SELECT column_x, column_y, round(r, 6) + 0.0 AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{x}' AS column_x, '{y}' AS column_y, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM lineitem"
        for x in _LINE_NUMBERS
        for y in _LINE_NUMBERS
    )
    + ")",
)
def correlation_matrix(spark, d):
    found = quality.correlation_matrix(C.table(spark, d, "lineitem"))
    return found.withColumn("r", F.round("r", 6) + F.lit(0.0))


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return selection.value_counts(C.table(spark, d, "orders"), "o_orderpriority")


@query(
    "grouped_quartiles",
    with_ctes(
        "encounters",
        "SELECT encounterclass, CAST(min(total_claim_cost) AS DOUBLE) AS min_value, "
        + ", ".join(
            f"CAST(CAST(quantile_cont(CAST(total_claim_cost AS DOUBLE), {p}) AS DECIMAL(18,6)) AS DOUBLE) AS {n}"
            for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        )
        + ", CAST(max(total_claim_cost) AS DOUBLE) AS max_value FROM encounters GROUP BY 1",
    ),
)
def grouped_quartiles(spark, d):
    rows = quality.grouped_quartiles(C.encounters(spark, d), "total_claim_cost", ["encounterclass"])
    return rounded(rows, ["q1", "median", "q3"])


@query(
    "banded_rate",
    """SELECT band, count(*) AS n, 100.0::DOUBLE * CAST(sum(f) AS DOUBLE) / count(*) AS rate_pct FROM (
         SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 6 THEN 'Low' WHEN l_quantity > 6 AND l_quantity <= 10 THEN 'Moderate'
                     WHEN l_quantity > 10 AND l_quantity <= 15 THEN 'High' WHEN l_quantity > 15 AND l_quantity <= 25 THEN 'Critical' END AS band,
                (l_returnflag = 'R')::INT AS f FROM lineitem) WHERE band IS NOT NULL GROUP BY 1""",
)
def banded_rate(spark, d):
    lines = C.table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    return quality.banded_rate(lines, "l_quantity", "flag")


# --- uploads --------------------------------------------------------------------------------------


def upload_of(spark, d):
    """A user's table with their own column names and text values."""
    return C.encounters(spark, d).select(
        F.col("patient").cast("string").alias("Patient ID"),
        # dates as users write them: ISO, month first, in words
        F.when(F.col("id") % 77 == 4, "not a date")
        .when(F.col("id") % 5 == 1, F.date_format("start", "MM/dd/yyyy"))
        .when(F.col("id") % 5 == 2, F.date_format("start", "MMM d, yyyy"))
        .otherwise(F.col("start").cast("string"))
        .alias("Encounter Date"),
        F.col("encounterclass").alias("EncounterClass"),
        F.when(F.col("id") % 91 == 5, "free").otherwise(F.col("total_claim_cost").cast("string")).alias("Total_Cost"),
        F.concat(F.lit("payer "), "payer").alias("Diagnosis Condition"),
    )


SQL_UPLOAD = """up AS (SELECT CAST(patient AS VARCHAR) AS patient_id,
    CASE WHEN id % 77 = 4 THEN NULL WHEN id % 5 IN (1, 2) THEN date_trunc('day', start)::TIMESTAMP ELSE start END AS encounter_date, encounterclass AS encounter_class,
    CASE WHEN id % 91 = 5 THEN NULL ELSE total_claim_cost END AS total_cost, concat('payer ', payer) AS condition FROM encounters)"""


@query(
    "standardize",
    with_ctes(
        "encounters",
        f"WITH {SQL_UPLOAD} SELECT patient_id, encounter_date, encounter_class, total_cost::DOUBLE AS total_cost, NULL::DOUBLE AS age, "
        "NULL::VARCHAR AS gender, condition, NULL::VARCHAR AS procedure, NULL::TIMESTAMP AS discharge_date FROM up",
    ),
)
def standardize(spark, d):
    return shown(uploads.standardize(upload_of(spark, d)))


@query("filter_by_value", "SELECT * FROM orders WHERE CAST(o_orderstatus AS VARCHAR) = 'F'")
def filter_by_value(spark, d):
    return selection.filter_by_value(C.table(spark, d, "orders"), "o_orderstatus", "F")


@query(
    "preview",
    """SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders) AS n_rows, 3::BIGINT AS n_columns
       FROM orders ORDER BY o_orderkey LIMIT 6""",
)
def preview(spark, d):
    orders = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return selection.preview(orders, [F.col("o_orderkey")], 6)


@query(
    "upload_kpis",
    with_ctes(
        "encounters",
        f"""WITH {SQL_UPLOAD} SELECT 'Encounters' AS label, CAST(count(*) AS DOUBLE) AS value FROM up
        UNION ALL SELECT 'Unique patients', CAST(count(DISTINCT patient_id) AS DOUBLE) FROM up
        UNION ALL SELECT 'Total cost', CAST(sum(total_cost) AS DOUBLE) FROM up
        UNION ALL SELECT 'Avg cost', CAST(sum(total_cost) AS DOUBLE) / count(total_cost) FROM up
        UNION ALL SELECT 'Encounter classes', CAST(count(DISTINCT encounter_class) AS DOUBLE) FROM up""",
    ),
)
def upload_kpis(spark, d):
    table = upload_of(spark, d)
    return uploads.upload_kpis(table, uploads.match_columns(table.columns))


@query(
    "upload_monthly_volume",
    with_ctes(
        "encounters",
        f"WITH {SQL_UPLOAD} SELECT date_trunc('month', encounter_date)::TIMESTAMP AS month, count(*) AS encounters FROM up "
        "WHERE encounter_date IS NOT NULL GROUP BY 1",
    ),
)
def upload_monthly_volume(spark, d):
    return uploads.monthly_volume(upload_of(spark, d), "Encounter Date")


@query(
    "upload_top_conditions",
    "SELECT p_brand AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS total_cost "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(CAST(l_extendedprice AS DECIMAL(28,2))) DESC, 1 LIMIT 10",
)
def upload_top_conditions(spark, d):
    lines = C.table(spark, d, "lineitem").join(C.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return uploads.top_by_cost(lines, "p_brand", "l_extendedprice")


@query(
    "detect_date_column",
    """SELECT 1::BIGINT AS position, 'Encounter Date' AS column_name,
       CAST(count(*) FILTER (o_orderkey % 77 <> 4) AS DOUBLE) / count(*) AS date_share FROM orders""",
)
def detect_date_column(spark, d):
    return uploads.detect_date_column(upload_of(spark, d))
