"""Gold views and the KPI records built on them. Functions take and return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.scalars import mean, month_start, seconds_between, years_between
from wardlake.scale import one_row


def admissions_summary(encounters: DataFrame) -> DataFrame:
    return (
        encounters.where(F.col("start").isNotNull())
        .groupBy(month_start(F.col("start")).alias("admission_month"), "encounterclass")
        .agg(
            F.count("*").alias("total_admissions"),
            mean(F.sum(seconds_between(F.col("start"), F.col("stop"))), F.count("stop")).alias("stay_seconds"),
            mean(F.sum("total_claim_cost"), F.count("total_claim_cost")).alias("avg_cost"),
        )
        .select(
            "admission_month",
            "encounterclass",
            "total_admissions",
            (F.col("stay_seconds") / 86400.0).alias("avg_stay_days"),
            "avg_cost",
        )
    )


def outcome_distribution(patients: DataFrame) -> DataFrame:
    outcome = F.when(F.col("deathdate").isNull(), "Alive").otherwise("Deceased")
    counted = patients.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("patients"))
    return counted.select("outcome", "patients", share_of_total(F.col("patients")).alias("pct"))


def share_of_total(n: Column) -> Column:
    """Percent of the grand total, for aggregated frames with one row per fixed class."""
    return F.lit(100.0) * n / F.sum(n).over(Window.partitionBy(F.lit(1)))


def comorbidity_prevalence(conditions: DataFrame, patients: DataFrame, listed: Sequence[str]) -> DataFrame:
    total = one_row(patients.agg(F.count("*").alias("n")))
    return (
        conditions.where(F.col("description").isin(list(listed)))
        .groupBy(F.col("description").alias("condition"))
        .agg(F.countDistinct("patient").alias("cases"))
        .withColumn("prevalence_pct", F.lit(100.0) * F.col("cases") / F.nullif(total, F.lit(0)))
    )


def condition_encounters(conditions: DataFrame, encounters: DataFrame) -> DataFrame:
    """Conditions joined to the encounter they were recorded in."""
    visit = encounters.select(F.col("id").alias("encounter"), "encounterclass", "total_claim_cost")
    return conditions.join(visit, "encounter", "inner")


def cost_by_condition(conditions: DataFrame, encounters: DataFrame, min_patients: int = 5) -> DataFrame:
    return (
        condition_encounters(conditions, encounters)
        .groupBy(F.col("description").alias("condition"))
        .agg(
            F.countDistinct("patient").alias("patients"),
            F.count("encounter").alias("encounters"),
            mean(F.sum("total_claim_cost"), F.count("total_claim_cost")).alias("avg_encounter_cost"),
            F.sum("total_claim_cost").cast("double").alias("total_cost"),
        )
        .where(F.col("patients") >= min_patients)
    )


def patient_rollup(
    patients: DataFrame, encounters: DataFrame, conditions: DataFrame, procedures: DataFrame
) -> DataFrame:
    """Patients left-joined to one pre-aggregated row per child table, so nothing fans out."""
    enc = encounters.groupBy(F.col("patient").alias("id")).agg(
        F.count("*").alias("total_encounters"), F.sum("total_claim_cost").alias("lifetime_cost")
    )
    cond = conditions.groupBy(F.col("patient").alias("id")).agg(F.countDistinct("code").alias("distinct_conditions"))
    proc = procedures.groupBy(F.col("patient").alias("id")).agg(F.countDistinct("code").alias("distinct_procedures"))
    zero = F.lit(0)
    return (
        patients.join(enc, "id", "left")
        .join(cond, "id", "left")
        .join(proc, "id", "left")
        .select(
            *patients.columns,
            F.coalesce("total_encounters", zero).alias("total_encounters"),
            F.coalesce("distinct_conditions", zero).alias("distinct_conditions"),
            F.coalesce("distinct_procedures", zero).alias("distinct_procedures"),
            F.coalesce(F.col("lifetime_cost").cast("double"), F.lit(0.0)).alias("lifetime_cost"),
        )
    )


def patient_360(
    patients: DataFrame, encounters: DataFrame, conditions: DataFrame, procedures: DataFrame, as_of: str
) -> DataFrame:
    age_at = F.coalesce(F.col("deathdate"), F.lit(as_of).cast("date"))
    return patient_rollup(patients, encounters, conditions, procedures).select(
        F.col("id").alias("patient_id"),
        "gender",
        "race",
        years_between(F.col("birthdate"), age_at).alias("age"),
        F.col("deathdate").isNotNull().alias("deceased"),
        "total_encounters",
        "distinct_conditions",
        "distinct_procedures",
        "lifetime_cost",
    )


def revenue_by_month(encounters: DataFrame) -> DataFrame:
    return (
        encounters.where(F.col("start").isNotNull())
        .groupBy(month_start(F.col("start")).alias("month"))
        .agg(
            F.count("*").alias("encounters"),
            F.sum("total_claim_cost").cast("double").alias("total_revenue"),
            F.sum("payer_coverage").cast("double").alias("payer_paid"),
            F.sum(F.col("total_claim_cost") - F.col("payer_coverage")).cast("double").alias("patient_paid"),
        )
    )


def kpi_rows(wide: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One-row frame of doubles turned into ``(label, value)`` records."""
    return wide.select(*[F.col(c).cast("double").alias(label) for c, label in labels.items()]).unpivot(
        [], list(labels.values()), "label", "value"
    )


def headline_kpis(profile: DataFrame, encounters: DataFrame) -> DataFrame:
    """Patients, deceased share, mean encounters, mean lifetime cost, total revenue."""
    revenue = one_row(encounters.where(F.col("start").isNotNull()).agg(F.sum("total_claim_cost").cast("double").alias("r")))
    wide = profile.agg(
        F.count("*").alias("patients"),
        (F.lit(100.0) * F.count_if("deceased") / F.nullif(F.count("*"), F.lit(0))).alias("deceased_pct"),
        mean(F.sum("total_encounters"), F.count("*")).alias("mean_encounters"),
        mean(F.sum(F.col("lifetime_cost").cast("decimal(28,2)")), F.count("*")).alias("mean_cost"),
    ).withColumn("revenue", revenue)
    return kpi_rows(
        wide,
        {
            "patients": "Patients",
            "deceased_pct": "Deceased %",
            "mean_encounters": "Avg encounters",
            "mean_cost": "Avg lifetime cost",
            "revenue": "Total revenue",
        },
    )


def quality_kpis(
    outcomes: DataFrame, prevalence: DataFrame, death_label: str = "Deceased", against_advice_label: str = "Dama"
) -> DataFrame:
    """Mortality %, against-advice discharge % and mean comorbidity prevalence; 0.0 where absent."""

    def pct_of(label: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("outcome") == label, F.col("pct"))), F.lit(0.0))

    burden = one_row(
        prevalence.agg(
            F.coalesce(mean(F.sum(F.col("prevalence_pct").cast("decimal(28,10)")), F.count("*")), F.lit(0.0)).alias("b")
        )
    )
    wide = outcomes.agg(pct_of(death_label).alias("m"), pct_of(against_advice_label).alias("d")).withColumn("b", burden)
    return kpi_rows(
        wide, {"m": "Mortality Rate", "d": "Discharge Against Advice", "b": "Comorbidity Burden"}
    ).withColumn("unit", F.lit("%"))


def hospital_kpis(visits: DataFrame) -> DataFrame:
    """KPIs of a flat hospital dataset; a KPI is left out when its column is missing."""
    from wardlake.functions.scalars import to_number

    def average(column: str, scale: float = 1.0) -> Column:
        number = to_number(F.col(column)).cast("decimal(28,4)")
        return F.lit(scale) * mean(F.sum(number), F.count(number))

    kpis: list[tuple[str, str | None, Column]] = [
        ("Total encounters", None, F.count("*")),
        ("Unique patients", "patient_id", F.countDistinct("patient_id")),
        ("30-day readmission rate", "readmitted", average("readmitted", 100.0)),
        (
            "Mortality rate",
            "outcome",
            F.lit(100.0) * F.count_if(F.lower(F.col("outcome").cast("string")) == "deceased") / F.nullif(F.count("*"), F.lit(0)),
        ),
        ("Avg treatment cost", "treatment_cost", average("treatment_cost")),
        ("Avg length of stay", "length_of_stay", average("length_of_stay")),
        ("Avg patient satisfaction", "patient_satisfaction", average("patient_satisfaction")),
    ]
    present = [(label, expr) for label, column, expr in kpis if column is None or column in visits.columns]
    wide = visits.agg(*[expr.cast("double").alias(label) for label, expr in present])
    return wide.unpivot([], [label for label, _ in present], "label", "value")


def admissions_digest(summary: DataFrame, recent_months: int = 12) -> DataFrame:
    """Totals per class, in all, and over the last ``recent_months`` calendar months of the data."""
    latest = one_row(summary.agg(F.max("admission_month").alias("m")))
    by_class = summary.groupBy(F.col("encounterclass").alias("item")).agg(F.sum("total_admissions").alias("admissions"))
    recent = F.col("admission_month") > F.add_months(latest, -recent_months).cast("timestamp_ntz")
    overall = summary.agg(
        F.sum("total_admissions").alias("all time"),
        F.sum(F.when(recent, F.col("total_admissions"))).alias("recent"),
    ).unpivot([], ["all time", "recent"], "item", "admissions")
    return by_class.withColumn("kind", F.lit("class")).unionByName(overall.withColumn("kind", F.lit("total")))


def rate_by_flag(df: DataFrame, outcome: str, flags: Sequence[str]) -> DataFrame:
    """Share of ``outcome`` among rows where each flag is 1."""
    wide = df.agg(
        *[
            mean(F.sum(F.when(F.col(f) == 1, F.col(outcome))), F.count_if((F.col(f) == 1) & F.col(outcome).isNotNull())).alias(f)
            for f in flags
        ]
    )
    return wide.unpivot([], list(flags), "flag", "rate")


def mean_by_group(df: DataFrame, group: str, measure: str) -> DataFrame:
    return df.groupBy(group).agg(mean(F.sum(measure), F.count(measure)).alias("mean_value"))
