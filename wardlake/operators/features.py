"""Inpatient feature base, risk targets and the feature matrix.

History is computed as "totals per patient and day, then windows over those totals, then windows
inside one day". No window ever spans all rows of a patient, so a patient with a large share of the
rows is spread over the days of the history, and nothing is joined on time alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.scalars import seconds_between, years_between
from wardlake.scale import exact_quantiles, quantile_scalar

NUMERIC_FEATURES = [
    "age",
    "stay_length_days",
    "prior_encounters",
    "total_claim_cost",
    "prior_conditions_count",
    "prior_emergency_visits",
    "days_since_last_encounter",
]
TARGETS = ["readmission", "mortality", "high_cost", "deterioration"]
# Columns a target is derived from and must not see.
TARGET_LEAKS = {"high_cost": ["total_claim_cost"]}

_BEFORE = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '0.000001' SECOND PRECEDING"


def _stays(encounters: DataFrame) -> DataFrame:
    return encounters.where(F.col("encounterclass") == "inpatient")


def _days_before(by: str = "patient") -> Window:
    return Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)


def _days_after(by: str = "patient") -> Window:
    return Window.partitionBy(by).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(carry, ["patient", "day"], "left")


def stay_sequence(encounters: DataFrame) -> DataFrame:
    """Inpatient stays with the next inpatient start and the number of earlier inpatient stays."""
    stays = _stays(encounters).select(
        F.col("id").alias("encounter_id"), "patient", "start", "stop", F.to_date("start").alias("day")
    )
    daily = stays.groupBy("patient", "day").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
    carry = daily.select(
        "patient",
        "day",
        F.coalesce(F.sum("n").over(_days_before()), F.lit(0)).alias("earlier"),
        F.lag("first_start").over(Window.partitionBy("patient").orderBy(F.desc("day"))).alias("later_start"),
    )
    today = Window.partitionBy("patient", "day").orderBy("start", "encounter_id")
    local = stays.select(
        "*", F.lead("start").over(today).alias("same_day_next"), (F.row_number().over(today) - 1).alias("same_day_prior")
    )
    return _with_carry(local, carry).select(
        "encounter_id",
        "patient",
        "start",
        "stop",
        F.coalesce("same_day_next", "later_start").alias("next_start"),
        (F.col("earlier") + F.col("same_day_prior")).alias("prior_encounters"),
    )


def first_occurrences(conditions: DataFrame) -> DataFrame:
    """First day each patient carried each code."""
    return conditions.where(F.col("code").isNotNull()).groupBy("patient", "code").agg(F.min("start").alias("start"))


def history(encounters: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every encounter with what was known before it: emergencies, latest earlier start, inpatient

    stays before and next, and distinct condition codes up to its day.
    """
    visits = encounters.select(
        "id",
        "patient",
        "start",
        "stop",
        "encounterclass",
        "total_claim_cost",
        F.to_date("start").alias("day"),
        (F.col("encounterclass") == "emergency").cast("int").alias("is_emergency"),
        F.when(F.col("encounterclass") == "inpatient", F.col("start")).alias("stay_start"),
    )
    visit_days = visits.groupBy("patient", "day").agg(
        F.sum("is_emergency").alias("emergencies"),
        F.max("start").alias("last_start"),
        F.count("stay_start").alias("stays"),
        F.min("stay_start").alias("first_stay"),
    )
    code_days = first_occurrences(conditions).groupBy("patient", F.to_date("start").alias("day")).agg(
        F.count("*").alias("new_codes")
    )
    days = (
        visit_days.unionByName(code_days, allowMissingColumns=True)
        .groupBy("patient", "day")
        .agg(
            F.sum("emergencies").alias("emergencies"),
            F.max("last_start").alias("last_start"),
            F.sum("stays").alias("stays"),
            F.min("first_stay").alias("first_stay"),
            F.sum("new_codes").alias("new_codes"),
        )
    )
    through = Window.partitionBy("patient").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carry = days.select(
        "patient",
        "day",
        F.coalesce(F.sum("emergencies").over(_days_before()), F.lit(0)).alias("emergencies_earlier"),
        F.max("last_start").over(_days_before()).alias("start_earlier"),
        F.coalesce(F.sum("stays").over(_days_before()), F.lit(0)).alias("stays_earlier"),
        F.coalesce(F.sum("new_codes").over(through), F.lit(0)).alias("codes"),
        F.last("first_stay", ignorenulls=True).over(_days_after()).alias("stay_later"),
    )
    upto = Window.partitionBy("patient", "day").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    beyond = (
        Window.partitionBy("patient", "day")
        .orderBy(F.desc("start"), F.desc("id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = visits.select(
        "*",
        F.expr(f"sum(is_emergency) OVER (PARTITION BY patient, day ORDER BY start {_BEFORE})").alias("emergencies_today"),
        F.expr(f"max(start) OVER (PARTITION BY patient, day ORDER BY start {_BEFORE})").alias("start_today"),
        F.count("stay_start").over(upto).alias("stays_today"),
        F.last("stay_start", ignorenulls=True).over(beyond).alias("stay_today"),
    )
    earlier = F.coalesce("start_today", "start_earlier")
    return _with_carry(local, carry).select(
        "id",
        "patient",
        "start",
        "stop",
        "encounterclass",
        "total_claim_cost",
        (F.col("emergencies_earlier") + F.coalesce("emergencies_today", F.lit(0))).alias("prior_emergency_visits"),
        earlier.alias("previous_start"),
        (F.col("stays_earlier") + F.col("stays_today")).alias("prior_encounters"),
        F.coalesce("stay_today", "stay_later").alias("next_start"),
        F.col("codes").alias("prior_conditions_count"),
    )


def days_since(previous: Column, start: Column) -> Column:
    """Whole days since the previous encounter, 0 when there is none."""
    return F.coalesce(F.extract(F.lit("DAY"), start - previous).cast("bigint"), F.lit(0).cast("bigint"))


def next_emergency(stays: DataFrame, encounters: DataFrame) -> DataFrame:
    """Adds ``next_emergency``: the first emergency start strictly after each stay's stop."""
    emergencies = encounters.where(F.col("encounterclass") == "emergency").select(
        "patient", F.col("start").alias("at"), F.col("start").alias("emergency_at"), F.lit(False).alias("is_stay")
    )
    queries = stays.withColumn("at", F.col("stop")).withColumn("is_stay", F.lit(True))
    points = queries.unionByName(emergencies, allowMissingColumns=True).withColumn("day", F.to_date("at"))
    daily = points.groupBy("patient", "day").agg(F.min("emergency_at").alias("first_emergency"))
    carry = daily.select(
        "patient", "day", F.last("first_emergency", ignorenulls=True).over(_days_after()).alias("later_emergency")
    )
    # descending in time, stays first at equal instants: what precedes a stay is strictly later than it
    later_today = (
        Window.partitionBy("patient", "day")
        .orderBy(F.desc("at"), F.desc("is_stay"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = points.withColumn("emergency_today", F.last("emergency_at", ignorenulls=True).over(later_today)).where("is_stay")
    return _with_carry(local, carry).select(
        *stays.columns, F.coalesce("emergency_today", "later_emergency").alias("next_emergency")
    )


def readmitted(next_start: Column, stop: Column) -> Column:
    """Another inpatient start within 30 days of discharge; an overlap counts too."""
    return F.coalesce(next_start - stop <= F.expr("INTERVAL '30' DAY"), F.lit(False))


def died_within(deathdate: Column, stop: Column, days: int = 30) -> Column:
    return F.coalesce(F.date_diff(deathdate, F.to_date(stop)).between(0, days), F.lit(False))


def emergency_within(next_at: Column, stop: Column) -> Column:
    return F.coalesce(next_at - stop <= F.expr("INTERVAL '30' DAY"), F.lit(False))


def inpatient_base(encounters: DataFrame, patients: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per inpatient stay with history features and the three time-based targets."""
    stays = history(encounters, conditions).where(F.col("encounterclass") == "inpatient")
    people = patients.select(F.col("id").alias("patient"), "gender", "birthdate", "deathdate")
    joined = next_emergency(stays, encounters).join(people, "patient", "inner")
    readmission = readmitted(F.col("next_start"), F.col("stop"))
    death = died_within(F.col("deathdate"), F.col("stop"))
    emergency = emergency_within(F.col("next_emergency"), F.col("stop"))
    return joined.select(
        F.col("id").alias("encounter_id"),
        "patient",
        "start",
        "stop",
        "gender",
        "deathdate",
        F.col("total_claim_cost").cast("double").alias("total_claim_cost"),
        (seconds_between(F.col("start"), F.col("stop")) / 86400.0).alias("stay_length_days"),
        "prior_encounters",
        years_between(F.col("birthdate"), F.col("start")).alias("age"),
        "prior_conditions_count",
        "prior_emergency_visits",
        days_since(F.col("previous_start"), F.col("start")).alias("days_since_last_encounter"),
        readmission.cast("int").alias("readmission"),
        death.cast("int").alias("mortality"),
        (readmission | death | emergency).cast("int").alias("deterioration"),
    )


def comorbidity_flags(stays: DataFrame, conditions: DataFrame, listed: Mapping[str, str]) -> DataFrame:
    """0/1 per listed condition: recorded at or before the stay started. One pass for all of them."""
    firsts = (
        conditions.where(F.col("description").isin(list(listed.values())))
        .groupBy("patient")
        .agg(*[F.min(F.when(F.col("description") == d, F.col("start"))).alias(f"first_{f}") for f, d in listed.items()])
    )
    flags = [
        F.coalesce((F.col(f"first_{f}").cast("timestamp_ntz") <= F.col("start")).cast("int"), F.lit(0)).alias(f) for f in listed
    ]
    return stays.join(firsts, "patient", "left").select(*stays.columns, *flags)


def mean_vitals(observations: DataFrame, vitals: Mapping[str, str]) -> DataFrame:
    """Mean numeric reading per encounter and vital; text readings are ignored."""
    reading = F.col("value").try_cast("double")
    return (
        observations.where(F.col("description").isin(list(vitals.values())))
        .groupBy("encounter")
        .agg(*[F.avg(F.when(F.col("description") == d, reading)).alias(v) for v, d in vitals.items()])
    )


def add_vitals(stays: DataFrame, observations: DataFrame, vitals: Mapping[str, str]) -> DataFrame:
    means = mean_vitals(observations, vitals).withColumnRenamed("encounter", "encounter_id")
    return stays.join(means, "encounter_id", "left").select(*stays.columns, *vitals)


def assemble(
    encounters: DataFrame,
    patients: DataFrame,
    conditions: DataFrame,
    observations: DataFrame,
    comorbidities: Mapping[str, str],
    vitals: Mapping[str, str],
) -> DataFrame:
    """Base, comorbidity flags and vitals; vitals may still be NULL. Materialize before reuse."""
    base = inpatient_base(encounters, patients, conditions)
    return add_vitals(comorbidity_flags(base, conditions, comorbidities), observations, vitals)


def fill_medians(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace NULLs by the exact median, taken from ``fit_on`` (default: all rows)."""
    fitted = exact_quantiles(fit_on if fit_on is not None else df, columns, [0.5]).collect()  # one row per column
    medians = {row["column"]: row["q"][0] for row in fitted if row["q"]}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in columns})


def feature_matrix(assembled: DataFrame, vitals: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Missing flag per vital, then median fill of every numeric feature."""
    flagged = assembled.select("*", *[F.col(v).isNull().cast("int").alias(f"{v}_missing") for v in vitals])
    return fill_medians(flagged, list(vitals), fit_on)


def high_cost(assembled: DataFrame, prob: float = 0.75, fit_on: DataFrame | None = None) -> DataFrame:
    """Adds ``high_cost``: cost at or above the interpolated top-quartile threshold."""
    source = (fit_on if fit_on is not None else assembled).select("total_claim_cost")
    threshold = quantile_scalar(source, "total_claim_cost", prob)
    return assembled.withColumn("high_cost", (F.col("total_claim_cost") >= threshold).cast("int"))


def feature_columns(target: str, comorbidities: Sequence[str], vitals: Sequence[str]) -> list[str]:
    """Features a target may see."""
    columns = [*NUMERIC_FEATURES, *vitals, *[f"{v}_missing" for v in vitals], *comorbidities]
    return [c for c in columns if c not in TARGET_LEAKS.get(target, [])]
