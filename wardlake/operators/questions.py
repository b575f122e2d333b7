"""Safety flags, routing and message flattening over tables of questions and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.scalars import strip

# Emergency wording (case-insensitive, word bounds).
MEDICAL_EMERGENCY = [
    r"\bchest pain\b",
    r"\bheart attack\b",
    r"\bcan('?t| ?not) breathe\b",
    r"\bdifficulty breathing\b",
    r"\bstruggling to breathe\b",
    r"\bchoking\b",
    r"\bstroke\b",
    r"\bface drooping\b",
    r"\bslurred speech\b",
    r"\bsudden (weakness|numbness)\b",
    r"\bsevere bleeding\b",
    r"\bbleeding (a lot|heavily|uncontrollably)\b",
    r"\banaphylaxis\b",
    r"\bsevere allergic reaction\b",
    r"\bunconscious\b",
    r"\bnot responding\b",
    r"\bseizure\b",
    r"\boverdose\b",
]
# Crisis wording.
MENTAL_HEALTH_CRISIS = [
    r"\bsuicid(e|al)\b",
    r"\bkill myself\b",
    r"\bend my life\b",
    r"\bself[- ]harm\b",
    r"\bhurt myself\b",
    r"\bwant to die\b",
]

# Routing keywords.
ANALYTICS_WORDS = [
    "summary", "admissions", "count", "how many", "total", "average",
    "trend", "breakdown", "statistics", "stats", "distribution", "volume",
]
PREDICTION_WORDS = [
    "predict", "forecast", "future", "next month", "risk", "expected",
    "projection", "estimate", "upcoming", "plan", "planning",
]
KNOWLEDGE_WORDS = [
    "what is", "explain", "guideline", "recommend", "treatment", "protocol",
    "why", "how do", "definition", "according to", "should",
]
FORECAST_VERBS = ["forecast", "predict", "projection", "project"]
MIN_CONFIDENCE = 0.34


def safety_flag(text: Column) -> Column:
    """Crisis wording first, then medical emergency, else NULL."""
    crisis = text.rlike("(?iu)" + "|".join(MENTAL_HEALTH_CRISIS))
    medical = text.rlike("(?iu)" + "|".join(MEDICAL_EMERGENCY))
    return F.when(crisis, "mental_health_crisis").when(medical, "medical_emergency")


def _matched(words: Sequence[str], lowered: str = "__q") -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.col(lowered).contains(w))


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds engine, confidence, matched words and the reason.

    The class with most keyword hits wins (analytics, then prediction, then rag on ties). A
    forecasting verb overrides another winner; no hit, or a weak share of the hits, falls back to rag.
    """
    scored = (
        questions.withColumn("__q", F.lower(F.coalesce(F.col(question), F.lit(""))))
        .withColumn("__a", _matched(ANALYTICS_WORDS))
        .withColumn("__p", _matched(PREDICTION_WORDS))
        .withColumn("__r", _matched(KNOWLEDGE_WORDS))
        .withColumn("__v", _matched(FORECAST_VERBS))
    )
    a, p, r = F.size("__a"), F.size("__p"), F.size("__r")
    top = F.greatest(a, p, r)
    winner = F.when(a == top, "analytics").when(p == top, "prediction").otherwise("rag")
    words = F.when(a == top, F.col("__a")).when(p == top, F.col("__p")).otherwise(F.col("__r"))
    share = top / F.nullif(a + p + r, F.lit(0))
    decided = scored.withColumns({"__winner": winner, "__words": words, "__share": share, "__top": top})
    none = F.array().cast("array<string>")
    cases: list[tuple[Column, str | Column, Column, Column, str]] = [
        (strip(F.col("__q")) == "", "rag", F.lit(0.0), none, "empty question"),
        (
            (F.size("__v") > 0) & (F.col("__winner") != "prediction"),
            "prediction", F.lit(1.0), F.col("__v"), "forecasting verb",
        ),
        (F.col("__top") == 0, "rag", F.lit(0.0), none, "no keyword"),
        (
            F.col("__share") < MIN_CONFIDENCE,
            "rag", F.bround("__share", 2), F.col("__words"), "low confidence",
        ),
        (F.lit(True), F.col("__winner"), F.bround("__share", 2), F.col("__words"), "keywords"),
    ]

    def pick(i: int) -> Column:
        chosen: Column | None = None
        for case in cases:
            value = case[i] if isinstance(case[i], Column) else F.lit(case[i])
            chosen = F.when(case[0], value) if chosen is None else chosen.when(case[0], value)
        return chosen

    return decided.select(
        *questions.columns,
        pick(1).alias("engine"),
        pick(2).alias("confidence"),
        pick(3).alias("matched"),
        pick(4).alias("reason"),
    )


def flatten_content(content: Column) -> Column:
    """A message that is plain text or a JSON list of blocks, as text: text blocks and bare strings, one per line."""
    blocks = F.from_json(content, "array<string>")
    text_of = F.transform(
        blocks,
        lambda b: F.when(
            b.startswith("{"),
            F.when(F.get_json_object(b, "$.type") == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))),
        ).otherwise(b),
    )
    kept = F.filter(text_of, lambda t: t.isNotNull() & (t != ""))
    is_list = F.btrim(content).startswith("[") & blocks.isNotNull()
    return F.when(is_list, strip(F.array_join(kept, "\n"))).otherwise(content)
