"""Provider scorecard: department cleaning, observed/expected ratios and what is derived from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.names import name_ratio, title_name
from wardlake.functions.scalars import key_mix
from wardlake.session import materialize

MIN_VOLUME = 30
FOLD_CUTOFF = 0.85
FOLD_FREQUENCY = 5
CLUSTER_OE = 1.25
CLUSTER_SHARE = 0.20
CLUSTER_MIN_SCORED = 5
BETTER_BELOW = 0.9
REVIEW_ABOVE = 1.1
UNASSIGNED = "Unassigned"
OUTCOMES = {
    "mortality": ("mortality_count", "expected_mortality"),
    "readmission": ("readmission_count", "expected_readmission"),
}
DIRECTORY_PAGE = 500


# --- department names ---------------------------------------------------------------------------


def similar_name_pairs(names: DataFrame, cutoff: float = FOLD_CUTOFF) -> DataFrame:
    """Pairs ``(name, candidate)`` of distinct names that can reach ``cutoff``, without comparing all pairs.

    Two names with ratio >= c share at least ``(1.5c - 1)(la + lb) - 1`` letter pairs, counting repeats:
    every unmatched letter can split the match once more, and each piece loses one letter pair. The other name is
    at least ``c / (2 - c)`` times as long. So each name only has to publish its rarest letter pairs, as
    many as leave that overlap uncovered, and qualifying names always meet on one of them.
    """
    if not 2 / 3 < cutoff <= 1:
        raise ValueError("cutoff must lie between 2/3 and 1")
    per_letter = (1.5 * cutoff - 1) * 2 / (2 - cutoff)
    letters = F.expr("transform(sequence(1, length(name) - 1), i -> substring(name, i, 2))")
    numbered = F.transform(
        "pairs",
        lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(F.col("pairs"), 1, i + 1), lambda q: q == p)).cast("string")),
    )
    sized = (
        names.where(F.length("name") > 1)
        .withColumn("len", F.length("name"))
        .withColumn("pairs", letters)
        .withColumn("needed", F.greatest(F.lit(1), F.ceil(F.col("len") * per_letter - 1 - 1e-9)))
        .withColumn("grams", numbered)
    )
    grams = sized.select("name", "n", "len", "needed", F.explode("grams").alias("gram"))
    spread = grams.groupBy("gram").agg(F.count("*").alias("names_with"))
    by_rarity = Window.partitionBy("name").orderBy("names_with", "gram")
    published = (
        grams.join(spread, "gram")
        .withColumn("at", F.row_number().over(by_rarity))
        .where(F.col("at") <= F.col("len") - 1 - F.col("needed") + 1)
    )
    small = published.select("gram", "name", "n", "len")
    big = published.select(
        "gram", F.col("name").alias("candidate"), F.col("n").alias("candidate_n"), F.col("len").alias("candidate_len")
    )
    shorter = F.least("len", "candidate_len")
    return (
        small.join(big, "gram")
        .where(F.col("candidate") != F.col("name"))
        .where(F.col("candidate_n") >= FOLD_FREQUENCY * F.col("n"))
        .where(2 * shorter >= F.lit(cutoff - 1e-9) * (F.col("len") + F.col("candidate_len")))
        .select("name", "candidate")
        .distinct()
    )


def fold_map(names: DataFrame, cutoff: float = FOLD_CUTOFF) -> DataFrame:
    """``(name, folded)``: the most similar name that is at least five times as frequent."""
    scored = similar_name_pairs(names, cutoff).withColumn("ratio", name_ratio("candidate", "name"))
    best = F.max(F.struct("ratio", "candidate"))
    return scored.where(F.col("ratio") >= cutoff).groupBy("name").agg(best.getField("candidate").alias("folded"))


def clean_departments(providers: DataFrame, column: str = "department_raw", into: str = "department") -> DataFrame:
    """Adds the cleaned department and ``department_note`` (missing, folded or NULL)."""
    raw = providers.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__raw")).agg(F.count("*").alias("n"))
    # distinct spellings only: written once, since the pair search reads them several times
    titled = materialize(raw.withColumn("name", title_name("__raw")), "department-names")
    names = titled.where(F.col("name") != "").groupBy("name").agg(F.sum("n").alias("n"))
    mapping = titled.join(fold_map(names), "name", "left").select("__raw", "name", "folded")
    joined = providers.join(mapping, F.col(column) == F.col("__raw"), "left")
    note = F.when(F.col(column).isNull(), "missing").when(F.col("folded").isNotNull(), "folded")
    return joined.select(
        *[c for c in providers.columns if c != into],
        F.coalesce("folded", "name", F.lit(UNASSIGNED)).alias(into),
        note.alias("department_note"),
    )


# --- observed / expected -------------------------------------------------------------------------


def to_cents(ratio: Column) -> Column:
    """Ratio kept at two decimals, the precision all thresholds are compared at."""
    return ratio.cast("decimal(18,2)").cast("double")


def suppressed(outcome: str) -> Column:
    observed, expected = OUTCOMES[outcome]
    low_volume = F.coalesce(F.col("encounters") < MIN_VOLUME, F.lit(False))
    return low_volume | F.col(observed).isNull() | F.col(expected).isNull() | F.coalesce(F.col(expected) <= 0, F.lit(False))


def provider_oe(providers: DataFrame) -> DataFrame:
    """Adds ``oe_<outcome>`` and ``suppressed_<outcome>``; a NULL volume alone does not suppress."""
    out = providers
    for outcome, (observed, expected) in OUTCOMES.items():
        ratio = to_cents(F.col(observed) / F.nullif(F.col(expected), F.lit(0.0)))
        out = out.withColumn(f"suppressed_{outcome}", suppressed(outcome)).withColumn(
            f"oe_{outcome}", F.when(~F.col(f"suppressed_{outcome}"), ratio)
        )
    return out


def pooled(outcome: str = "mortality") -> Column:
    """Sum of observed over sum of expected, NULL unless some is expected. Sums in decimals, so the

    result does not depend on how rows are spread over tasks.
    """
    observed, expected = OUTCOMES[outcome]
    total = F.sum(F.col(expected).cast("decimal(28,10)")).cast("double")
    return F.when(total > 0, F.sum(observed) / total)


def department_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("department").agg(
        F.count("*").alias("doctors"),
        F.coalesce(F.sum("encounters"), F.lit(0)).alias("encounters"),
        to_cents(pooled()).alias("oe"),
    )


def department_oe_rank(scored: DataFrame) -> DataFrame:
    """Pooled O/E per department, best first, without the unassigned group."""
    rows = scored.where(F.col("department") != UNASSIGNED).groupBy("department").agg(to_cents(pooled()).alias("oe"))
    return rows.where(F.col("oe").isNotNull()).orderBy("oe", "department")


def hospital_oe(scored: DataFrame) -> DataFrame:
    oe = F.col("oe")
    wording = F.when(oe < 1.0, "better than").when(oe <= 1.02, "about as").when(oe.isNotNull(), "worse than")
    return scored.agg(pooled().alias("oe")).withColumn("wording", wording)


def cluster_flag(scored: DataFrame) -> DataFrame:
    """Departments, other than the best one, where many scored providers run well above expected."""
    best = department_oe_rank(scored).limit(1).select(F.col("department").alias("best"))
    counts = scored.groupBy("department").agg(
        F.count("oe_mortality").alias("scored"), F.count_if(F.col("oe_mortality") > CLUSTER_OE).alias("above")
    )
    kept = counts.where(
        (F.col("scored") >= CLUSTER_MIN_SCORED) & (F.col("above") / F.nullif(F.col("scored"), F.lit(0)) > F.lit(CLUSTER_SHARE))
    )
    return kept.join(best, F.col("department") == F.col("best"), "left_anti")


def bucket(oe: Column) -> Column:
    return (
        F.when(oe.isNull(), "not scored").when(oe < BETTER_BELOW, "better").when(oe > REVIEW_ABOVE, "review").otherwise("expected")
    )


def provider_bucket(scored: DataFrame) -> DataFrame:
    return scored.groupBy("department", bucket(F.col("oe_mortality")).alias("bucket")).agg(F.count("*").alias("n"))


def department_insights(scored: DataFrame) -> DataFrame:
    """Scored, flagged, pooled O/E against the hospital's, best and worst provider per department."""
    hospital = scored.agg(F.coalesce(to_cents(pooled()), F.lit(1.0)).alias("h")).scalar()
    # of equal ratios the provider with the smaller id is named, whatever type ids have
    is_scored = F.col("oe_mortality").isNotNull()
    lowest = F.when(is_scored, F.struct("oe_mortality", "doctor_id", "doctor_name"))
    highest = F.when(is_scored, F.struct((-F.col("oe_mortality")).alias("turned"), "doctor_id", "doctor_name"))
    rows = scored.groupBy("department").agg(
        F.count("oe_mortality").alias("scored"),
        F.count_if(F.col("oe_mortality") > REVIEW_ABOVE).alias("flagged"),
        pooled().alias("department_oe"),
        F.min(lowest).getField("doctor_name").alias("best_provider"),
        F.min(highest).getField("doctor_name").alias("worst_provider"),
    )
    against = (
        F.when(F.col("department_oe") < F.col("hospital_oe"), "better than")
        .when(F.col("department_oe") > F.col("hospital_oe"), "worse than")
        .otherwise("in line with")
    )
    return (
        rows.where(F.col("scored") > 0)
        .withColumn("flagged_pct", F.lit(100.0) * F.col("flagged") / F.col("scored"))
        .withColumn("hospital_oe", hospital)
        .withColumn("against_hospital", against)
    )


def provider_vs_department(scored: DataFrame) -> DataFrame:
    """Each provider beside the department's mean volume and pooled ratios. The department figures are

    aggregated first and joined, so a large department is not gathered in one window.
    """
    means = scored.groupBy("department").agg(
        F.floor(F.sum("encounters").cast("double") / F.count("encounters")).alias("department_volume"),
        pooled("mortality").alias("department_oe_mortality"),
        pooled("readmission").alias("department_oe_readmission"),
    )
    volume = F.when(F.col("encounters") >= F.col("department_volume"), "above average").when(
        F.col("encounters") < F.col("department_volume"), "below average"
    )
    return scored.join(means, "department").select(
        "doctor_id",
        "doctor_name",
        "department",
        "encounters",
        "department_volume",
        volume.alias("volume_note"),
        "oe_mortality",
        "department_oe_mortality",
        "oe_readmission",
        "department_oe_readmission",
        bucket(F.col("oe_mortality")).alias("status"),
    )


def handling_report(scored: DataFrame) -> DataFrame:
    """What was done to the data: ``(note, n)`` records."""
    notes: Mapping[str, Column] = {
        "departments missing": F.count_if(F.col("department_note") == "missing"),
        "department typos folded": F.count_if(F.col("department_note") == "folded"),
        **{f"{o} suppressed": F.count_if(f"suppressed_{o}") for o in OUTCOMES},
        "providers not scored": F.count_if(F.col("oe_mortality").isNull()),
    }
    return scored.agg(*[c.alias(note) for note, c in notes.items()]).unpivot([], list(notes), "note", "n")


# --- directory -----------------------------------------------------------------------------------


def department_column(df: DataFrame) -> str:
    """First column that names a department."""
    for name in df.columns:
        if name.lower() in {"department", "dept", "specialty"}:
            return name
    raise ValueError("no department column")


def headcount_matching(df: DataFrame, text: str) -> DataFrame:
    """Providers whose department contains the text, in any case."""
    hit = F.lower(F.col(department_column(df))).contains(text.lower())
    return df.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("providers"))


def headcount(df: DataFrame, k: int = 10) -> DataFrame:
    """Total providers, distinct departments, and the largest departments as ``(item, n)``."""
    column = F.col(department_column(df))
    totals = df.agg(F.count("*").alias("total providers"), F.count_distinct(column).alias("departments")).unpivot(
        [], ["total providers", "departments"], "item", "n"
    )
    largest = (
        df.where(column.isNotNull())
        .groupBy(column.alias("item"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "item")
        .limit(k)
    )
    return totals.unionByName(largest)


def provider_directory(providers: DataFrame, page_size: int = DIRECTORY_PAGE) -> DataFrame:
    """Providers nested under their department, in pages, so no row grows with the department."""
    named = providers.select(
        F.coalesce("department", F.lit(UNASSIGNED)).alias("department"),
        "doctor_id",
        "doctor_name",
        F.coalesce("encounters", F.lit(0)).alias("encounters"),
    )
    sizes = named.groupBy("department").agg(F.ceil(F.count("*") / F.lit(page_size)).alias("pages"))
    return (
        named.join(sizes, "department")
        .withColumn("page", key_mix(F.col("doctor_id")) % F.col("pages"))
        .groupBy("department", "page")
        .agg(F.sort_array(F.collect_list(F.struct("doctor_id", "doctor_name", "encounters"))).alias("doctors"))
    )


