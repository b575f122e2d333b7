"""Equi-joins whose left side may hold a third of its rows under one key, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.session import materialize

# Keys may be called hot if they hold more than 1 / HOT_SHARE of the rows: so there are at most that many.
HOT_SHARE = 20_000
# Most rows of ids that are broadcast; above that the join shuffles.
MAX_BROADCAST_ROWS = 1_000_000
# Edges that go through a star round in one task: so few cost less than the tasks of the round's shuffles.
FEW_EDGES = 200_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Column, values: list[str]) -> DataFrame:
    """Left join of ``left`` with the unique rows (``keys``, ``values``) of ``right``.

    The rows of ``right`` that ``hot`` marks, at most HOT_SHARE, are broadcast. Left rows that found one of them go
    through the second join spread over all tasks, since nothing is left to look up for them.
    """
    first = right.where(hot).select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__is_hot"))
    rest = right.where(~hot).select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(v).alias(f"__rest_{v}") for v in values])
    marked = left.join(F.broadcast(first), keys, "left")
    spread = F.when(F.col("__is_hot"), F.xxhash64(*[F.col(c) for c in left.columns]))
    marked = marked.withColumns({f"__l_{k}": F.coalesce(spread, k) if i == 0 else F.col(k) for i, k in enumerate(keys)})
    met = [F.col(f"__l_{k}") == F.col(f"__r_{k}") for k in keys]
    joined = marked.join(rest, met, "left")
    found = [F.when(F.col("__is_hot"), F.col(f"__hot_{v}")).otherwise(F.col(f"__rest_{v}")).alias(v) for v in values]
    return joined.select(*left.columns, *found)


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; few ids are broadcast, so that ``df`` is not shuffled for them."""
    few = ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the edges (a, b): the smallest id it can reach.

    Alternates large-star and small-star rounds: every vertex ties its larger neighbours, then its smaller ones, to
    the smallest it knows, until only stars around the smallest ids are left. Takes a logarithmic number of rounds.
    """
    stars = materialize(_directed(edges), "edges")
    state = _state(stars)
    while True:
        # a single partition meets every grouping and join of the round without a shuffle
        held = stars.coalesce(1) if state[0] <= FEW_EDGES else stars
        stars = materialize(_small_star(_large_star(held)), "edges")
        after = _state(stars)
        if after == state:
            break
        state = after
    roots = stars.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return stars.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("high").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("high").alias("v")))
    both = stars.select(F.inline(ends))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.where("v > u").join(least, "u").where("v <> m")
    return tied.select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("high").agg(F.min("low").alias("m"))
    # an edge to the smallest itself stays, any other also ties its lower end to the smallest
    own = F.struct("high", F.col("m").alias("low"))
    tied = F.struct(F.col("low").alias("high"), F.col("m").alias("low"))
    ends = F.when(F.col("low") == F.col("m"), F.array(own)).otherwise(F.array(tied))
    return stars.join(least, "high").select(F.inline(ends)).distinct()
