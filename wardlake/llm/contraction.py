"""Subtree sums of a forest by parallel tree contraction.

Every node keeps how many of its children are left and the exclusive-or of their ids, so that an only child is known
without a search. Rounds alternate:

* rake: nodes without children are done; what they hold goes to their parents, added up per parent before the join;
* compress: a chain of nodes with one child each is spliced out. Its nodes learn by pointer doubling (self-joins on the
  pointer, which is unique among the nodes still under way) what the chain holds below them and the node the chain ends
  at, which then hangs from the parent of the chain.

After a round every inner node has two children at least, so a round removes half of the nodes: rounds and joins are
logarithmic in the number of nodes, however deep the forest is. Then the rounds are undone from the last to the first:
a spliced node's sum is what its chain held plus the sum of the node it points to. Nodes of one long chain all point to
one node, so that join sends keys of many rows by a broadcast of at most ``HOT_SHARE`` rows.

Every step is written to the shared folder, so a lost executor repeats one step only.

Defined results: a node whose parent is null or absent is a root; an empty table gives no rows; a null value counts 0;
ids must be unique, and parents that form a cycle raise ValueError.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.joins import HOT_SHARE, hot_join
from wardlake.session import materialize


def _zero(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0).cast("bigint"))


def _keyed(df: DataFrame, key: str, values: Sequence[str], prefix: str = "__g_") -> DataFrame:
    return df.select(F.col(key).alias(f"{prefix}key"), *[F.col(v).alias(f"{prefix}{v}") for v in values])


def _rake(alive: DataFrame, values: list[str]) -> DataFrame:
    """The nodes with children, after those without handed over what they hold."""
    gifts = alive.where("n = 0 AND parent IS NOT NULL").groupBy("parent").agg(
        F.count("*").alias("n"), F.bit_xor("id").alias("kids"), *[F.sum(v).alias(v) for v in values]
    )
    joined = alive.where("n > 0").join(_keyed(gifts, "parent", ["n", "kids", *values]), F.col("id") == F.col("__g_key"), "left")
    return joined.select(
        "id",
        "parent",
        (F.col("n") - _zero("__g_n")).alias("n"),
        F.col("kids").bitwiseXOR(_zero("__g_kids")).alias("kids"),
        *[(F.col(v) + _zero(f"__g_{v}")).alias(v) for v in values],
    )


def _chains(unary: DataFrame, values: list[str], n_nodes: int) -> DataFrame:
    """``unary`` (id, parent, ptr, values) with ``ptr`` moved to the end of the chain and the values summed on the way."""
    ids = unary.select(F.col("id").alias("__next"))
    started = unary.join(ids, F.col("ptr") == F.col("__next"), "left")
    state = materialize(started.withColumn("ended", F.col("__next").isNull()).drop("__next"), "chains")
    for _ in range(n_nodes.bit_length() + 1):  # no chain is longer than all nodes
        if state.where("NOT ended").isEmpty():
            return state.drop("ended")
        ahead = _keyed(state, "id", ["ptr", "ended", *values])
        moved = state.where("NOT ended").join(ahead, F.col("ptr") == F.col("__g_key"))
        moved = moved.select(
            "id", "parent", F.col("__g_ptr").alias("ptr"), *[(F.col(v) + F.col(f"__g_{v}")).alias(v) for v in values],
            F.col("__g_ended").alias("ended"),
        )
        state = materialize(state.where("ended").unionByName(moved), "chains")
    raise ValueError("the parents form a cycle")


def _splice(alive: DataFrame, unary: DataFrame, chains: DataFrame, values: list[str]) -> DataFrame:
    """The nodes outside chains: the ends of chains get new parents, the parents what the chains held."""
    inside = unary.select(F.col("ptr").alias("__inside"))
    tops = materialize(chains.join(inside, F.col("id") == F.col("__inside"), "left_anti"), "tops")
    gifts = tops.where("parent IS NOT NULL").groupBy("parent").agg(
        F.bit_xor(F.col("id").bitwiseXOR(F.col("ptr"))).alias("kids"), *[F.sum(v).alias(v) for v in values]
    )
    rest = alive.where("n <> 1 OR parent IS NULL")
    lifted = rest.join(_keyed(tops, "ptr", ["parent"], "__t_"), F.col("id") == F.col("__t_key"), "left")
    joined = lifted.join(_keyed(gifts, "parent", ["kids", *values]), F.col("id") == F.col("__g_key"), "left")
    return joined.select(
        "id",
        F.coalesce("__t_parent", "parent").alias("parent"),
        "n",
        F.col("kids").bitwiseXOR(_zero("__g_kids")).alias("kids"),
        *[(F.col(v) + _zero(f"__g_{v}")).alias(v) for v in values],
    )


def _expanded(spliced: DataFrame, known: DataFrame, values: list[str]) -> DataFrame:
    """Sums of spliced nodes from the sums of the nodes they point to."""
    wanted = spliced.groupBy(F.col("ptr").alias("__g_key")).agg(F.count("*").alias("__rows"))
    ends = known.join(wanted, F.col("id") == F.col("__g_key")).select(
        F.col("id").alias("ptr"), "__rows", *[F.col(v).alias(f"__end_{v}") for v in values]
    )
    hot = F.col("__rows") * HOT_SHARE >= F.lit(spliced.count())
    met = hot_join(spliced.select("id", "ptr", *values), ends, ["ptr"], hot, [f"__end_{v}" for v in values])
    return met.select("id", *[(F.col(v) + F.col(f"__end_{v}")).alias(v) for v in values])


def subtree_sums(forest: DataFrame, values: Sequence[str]) -> DataFrame:
    """(id, values): for every node of ``forest`` (id bigint, parent bigint, values bigint) the sums over its subtree."""
    values = list(values)
    nodes = forest.select("id", "parent", *[_zero(F.col(v).cast("bigint")).alias(v) for v in values])
    families = forest.where("parent IS NOT NULL").groupBy("parent").agg(
        F.count("*").alias("n"), F.bit_xor("id").alias("kids")
    )
    counted = nodes.join(_keyed(families, "parent", ["n", "kids"]), F.col("id") == F.col("__g_key"), "left")
    alive = materialize(
        counted.select("id", "parent", _zero("__g_n").alias("n"), _zero("__g_kids").alias("kids"), *values), "alive"
    )
    rounds: list[tuple[DataFrame, DataFrame | None]] = []  # what was raked, then what was spliced
    left = alive.count()
    while left:
        raked = alive.where("n = 0").select("id", *values)
        alive = materialize(_rake(alive, values), "alive")
        unary = alive.where("n = 1 AND parent IS NOT NULL").select("id", "parent", F.col("kids").alias("ptr"), *values)
        spliced = None
        if not unary.isEmpty():
            spliced = _chains(unary, values, left)
            alive = materialize(_splice(alive, unary, spliced, values), "alive")
        rounds.append((raked, spliced))
        before, left = left, alive.count()
        if left == before:
            raise ValueError("the parents form a cycle")
    known = None
    for raked, spliced in reversed(rounds):
        if spliced is not None:
            known = known.unionByName(materialize(_expanded(spliced, known, values), "sums"))
        known = raked if known is None else known.unionByName(raked)
    return known if known is not None else nodes.select("id", *values)
