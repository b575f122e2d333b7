"""Retrieval, answer and tool-call evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5
GRID = (3, 5, 10)
# Tools that exist.
VALID_TOOLS = ["search_guidelines", "get_hospital_kpis", "forecast_admissions", "get_doctor_stats"]


def discount(k: int) -> list[float]:
    """Gain of a relevant item at each of the first k ranks."""
    return [1.0 / math.log2(rank + 1) for rank in range(1, k + 1)]


def ideal(k: int) -> list[float]:
    """Best gain reachable with 0..k relevant items."""
    out = [0.0]
    for gain in discount(k):
        out.append(out[-1] + gain)
    return out


def mark_relevant(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``relevant`` by an equi-join with the gold rows ``(query_id, doc_id)``."""
    known = gold.select("query_id", "doc_id").distinct().withColumn("__gold", F.lit(1))
    return ranked.join(known, ["query_id", "doc_id"], "left").withColumn(
        "relevant", F.coalesce("__gold", F.lit(0))
    ).drop("__gold")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = K) -> DataFrame:
    """Per question: hit, reciprocal rank, NDCG@k, P@1, P@3, P@k and recall@k.

    A document retrieved twice counts twice in precision and NDCG and once in recall. The ideal
    ordering is the retrieved list sorted by relevance. Questions without results, or whose gold row names no document,
    score 0.
    """
    marked = mark_relevant(ranked.where(F.col("rank") <= k), gold)
    at = [F.max(F.when(F.col("rank") == i, F.col("relevant"))) for i in range(1, k + 1)]
    found = marked.groupBy("query_id").agg(
        *[F.coalesce(c, F.lit(0)).alias(f"r{i}") for i, c in enumerate(at, 1)],
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
        F.count_distinct(F.when(F.col("relevant") == 1, F.col("doc_id"))).alias("docs"),
    )
    wanted = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("gold_docs"))
    joined = wanted.join(found, "query_id", "left").fillna(0, [f"r{i}" for i in range(1, k + 1)] + ["docs"])

    def hits(n: int) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"r{i}") for i in range(1, n + 1)])

    gain = reduce(lambda a, b: a + b, [F.col(f"r{i}") * F.lit(w) for i, w in enumerate(discount(k), 1)])
    best = F.element_at(F.array(*[F.lit(v) for v in ideal(k)]), hits(k) + 1)
    return joined.select(
        "query_id",
        (hits(k) > 0).cast("int").alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(hits(k) > 0, gain / best).otherwise(0.0).alias("ndcg"),
        (hits(1) / F.lit(1.0)).alias("p_at_1"),
        (hits(min(3, k)) / F.lit(3.0)).alias("p_at_3"),
        (hits(k) / F.lit(float(k))).alias("p_at_k"),
        F.coalesce(F.col("docs") / F.nullif(F.col("gold_docs"), F.lit(0)), F.lit(0.0)).alias("recall"),
    )


METRICS = ["hit", "mrr", "ndcg", "p_at_1", "p_at_3", "p_at_k", "recall"]


def exact_mean(name: str) -> Column:
    """Mean with a decimal sum, so it does not depend on row order."""
    return (F.sum(F.col(name).cast("double").cast("decimal(28,12)")).cast("double") / F.count(name)).alias(name)


def retrieval_summary(per_question: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_question.groupBy(*keys).agg(F.count("*").alias("n"), *[exact_mean(m) for m in METRICS])


def retrieval_grid(ranked: DataFrame, gold: DataFrame, mode: str, ks: Sequence[int] = GRID) -> DataFrame:
    """Summary per k from one search at the largest k."""
    parts = [
        retrieval_summary(retrieval_metrics(ranked, gold, k)).select(
            F.lit(k).cast("bigint").alias("k"), F.lit(mode).alias("rerank"), "hit", "mrr", "ndcg", "p_at_1", "p_at_k", "recall"
        )
        for k in ks
    ]
    return reduce(DataFrame.unionByName, parts)


def first_hit(ranked: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """Rank of the first relevant item per question, 0 when there is none."""
    first = mark_relevant(ranked, gold).groupBy("query_id").agg(
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first")
    )
    asked = gold.select("query_id").distinct()
    return asked.join(first, "query_id", "left").select("query_id", F.coalesce("first", F.lit(0)).alias(name))


def rerank_lift(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """Hit rate and MRR before and after re-ranking."""
    both = first_hit(before, gold, "b").join(first_hit(after, gold, "a"), "query_id")

    def rate(c: str) -> Column:
        return F.count_if(F.col(c) > 0) / F.nullif(F.count("*"), F.lit(0))

    def mrr(c: str) -> Column:
        return F.avg(F.when(F.col(c) > 0, 1.0 / F.col(c)).otherwise(0.0))

    return both.agg(
        F.count("*").alias("n"),
        rate("b").alias("hit_rate_retrieval_only"),
        rate("a").alias("hit_rate_reranked"),
        mrr("b").alias("mrr_retrieval_only"),
        mrr("a").alias("mrr_reranked"),
        (rate("a") - rate("b")).alias("hit_rate_lift"),
    )


def answer_checks(answers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Answered and failed counts, latency and share of answers citing ``[n]``. A failed answer is NULL."""
    answered = F.count("answer")
    latency = F.when(F.col("answer").isNotNull(), F.col("latency").cast("decimal(28,6)"))
    return answers.groupBy(*keys).agg(
        F.count("*").alias("n"),
        answered.alias("answered"),
        F.count_if(F.col("answer").isNull()).alias("failed"),
        F.coalesce(F.sum(latency).cast("double") / F.nullif(answered, F.lit(0)), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.max(latency).cast("double"), F.lit(0.0)).alias("max_latency"),
        F.coalesce(F.count_if(F.col("answer").rlike(r"\[\d+\]")) / F.nullif(answered, F.lit(0)), F.lit(0.0)).alias("citation_rate"),
    )


def set_overlap(df: DataFrame, expected: str, called: str) -> DataFrame:
    """Distinct overlap size, subset and equality of two sets held as arrays."""
    want, got = F.array_distinct(expected), F.array_distinct(called)
    return df.select(
        "*",
        F.size(F.array_intersect(want, got)).alias("overlap"),
        (F.size(F.array_except(want, got)) == 0).alias("is_subset"),
        (F.array_sort(want) == F.array_sort(got)).alias("is_equal"),
    )


def tool_call_rows(log: DataFrame, valid: Sequence[str] = VALID_TOOLS) -> DataFrame:
    """Exact and partial match, and invalid calls per logged question. ``called`` may repeat a tool."""
    marked = set_overlap(log, "expected", "called")
    exact = F.col("is_equal").cast("int")
    superset = F.when((F.size("expected") > 0) & F.col("is_subset"), 1).otherwise(exact)
    invalid = F.size(F.filter("called", lambda t: ~t.isin(list(valid))))
    return marked.select("*", exact.alias("exact_match"), superset.alias("partial_match"), invalid.alias("invalid_calls"))


def tool_call_scores(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def share(c: str) -> Column:
        return F.sum(c).cast("double") / F.count("*")

    return tool_call_rows(log).groupBy(*keys).agg(
        F.count("*").alias("n"),
        share("exact_match").alias("exact_accuracy"),
        share("partial_match").alias("partial_accuracy"),
        share("completed").alias("completion_rate"),
        F.sum("invalid_calls").alias("invalid_calls"),
        share("steps").alias("avg_steps"),
    )
