"""Text bronze tables to typed silver tables; unreadable values become NULL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Columns kept per silver table.
KEPT = {
    "patients": [
        "id", "birthdate", "deathdate", "marital", "race", "ethnicity", "gender", "city", "state", "county", "zip",
        "healthcare_expenses", "healthcare_coverage", "income",
    ],
    "encounters": [
        "id", "start", "stop", "patient", "organization", "payer", "encounterclass", "code", "description",
        "base_encounter_cost", "total_claim_cost", "payer_coverage", "reasoncode", "reasondescription",
    ],
    "conditions": ["start", "stop", "patient", "encounter", "system", "code", "description"],
    "observations": [
        "date", "patient", "encounter", "category", "code", "description", "value", "units", "type",
    ],
    "procedures": [
        "start", "stop", "patient", "encounter", "system", "code", "description", "base_cost", "reasoncode",
        "reasondescription",
    ],
}


def _as(kind: str, name: str) -> Column:
    return F.trim(F.col(name)).try_cast(kind).alias(name)


def _typed(df: DataFrame, name: str, kinds: dict[str, Sequence[str]]) -> DataFrame:
    kind_of = {column: kind for kind, columns in kinds.items() for column in columns}
    return df.select(*[_as(kind_of[c], c) if c in kind_of else F.col(c) for c in KEPT[name]])


def silver_patients(bronze: DataFrame) -> DataFrame:
    return _typed(
        bronze,
        "patients",
        {"date": ["birthdate", "deathdate"], MONEY: ["healthcare_expenses", "healthcare_coverage", "income"]},
    )


def silver_encounters(bronze: DataFrame) -> DataFrame:
    return _typed(
        bronze,
        "encounters",
        {
            "timestamp_ntz": ["start", "stop"],
            MONEY: ["base_encounter_cost", "total_claim_cost", "payer_coverage"],
        },
    )


def silver_conditions(bronze: DataFrame) -> DataFrame:
    """Timestamps or dates are reduced to dates."""
    typed = _typed(bronze, "conditions", {"timestamp_ntz": ["start", "stop"]})
    return typed.withColumns({c: F.col(c).cast("date") for c in ("start", "stop")})


def silver_observations(bronze: DataFrame) -> DataFrame:
    """``value`` stays text: it mixes numbers and words."""
    return _typed(bronze, "observations", {"timestamp_ntz": ["date"]})


def silver_procedures(bronze: DataFrame) -> DataFrame:
    return _typed(bronze, "procedures", {"timestamp_ntz": ["start", "stop"], MONEY: ["base_cost"]})


SILVER: dict[str, Callable[[DataFrame], DataFrame]] = {
    "patients": silver_patients,
    "encounters": silver_encounters,
    "conditions": silver_conditions,
    "observations": silver_observations,
    "procedures": silver_procedures,
}
