"""Mutual information between numbers and classes from nearest neighbours, without bins.

For every row the distance to its k-th nearest value of the same class says how dense the class is there, and the number
of rows of any class within that distance how dense all are; the information is

    psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(rows within the distance)

with the digamma function psi. On one column neighbours are neighbours in sorted order: values are range-sorted per
(column, class) and numbered, cut into blocks of rows with k rows of overlap on both sides, and looked at inside blocks.
Rows within a distance are differences of two ranks, which come from one running count over values and thresholds sorted
together. No class, column or common value ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.scale import null_safe_join, sorted_running
from wardlake.session import materialize

NEIGHBOURS = 3
# Rows of one class that one task looks at.
BLOCK_ROWS = 50_000
# Thresholds sort before or after equal values.
BELOW, VALUE, UP_TO = 0, 1, 2


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: by the recurrence up to seven or more, and the asymptotic series there."""
    y = n + F.lit(6.0)
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - sum((1 / (n + F.lit(float(i))) for i in range(6)), F.lit(0.0))


def _long(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, label, x, row): one row per present value whose class has another one in that column."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    label = F.coalesce(F.col(target).cast("string"), F.lit("Missing")).alias("label")
    rows = df.select(label, F.inline(cells)).where("x IS NOT NULL AND NOT isnan(x)")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "neighbour-values")


def _distances(rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(feature, label, x, row, k, d): the distance to the k-th neighbour of the same class, k less in small classes."""
    placed = sorted_running(rows, ["feature", "label"], [F.col("x"), F.col("row")], {"pos": F.lit(1).cast("bigint")}, "neighbours")
    block, inside = F.floor((F.col("pos") - 1) / block_rows), (F.col("pos") - 1) % block_rows
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    before = F.when((inside < k) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
    after = F.when(inside >= block_rows - k, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
    spread = placed.select("feature", "label", "x", "row", "pos", F.explode(F.filter(F.array(own, before, after), lambda b: b.isNotNull())).alias("b"))
    order = Window.partitionBy("feature", "label", "b.block").orderBy("pos")
    near = [F.col("x") - F.lag("x", j).over(order) for j in range(1, k + 1)]
    near += [F.lead("x", j).over(order) - F.col("x") for j in range(1, k + 1)]
    found = spread.select("*", F.array_sort(F.filter(F.array(*near), lambda d: d.isNotNull())).alias("near"))
    sized = F.least(F.size("near"), F.lit(k))
    kept = found.where("b.own").withColumn("k", sized)
    return kept.select("feature", "label", "x", "row", "k", "near")


def neighbour_information(
    df: DataFrame, target: str, columns: Sequence[str], k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(feature, score)`` of number columns against the classes of ``target``, in nats and never below 0.

    Missing values are left out of their column, a missing target is a class, and classes of one value are left out.
    """
    if block_rows <= 2 * k:
        raise ValueError("blocks must be larger than two sides of neighbours")
    rows = _long(df, target, columns)
    classes = rows.groupBy("feature", "label").agg(F.count("*").alias("size"))
    near = null_safe_join(_distances(rows, k, block_rows), classes, ["feature", "label"]).where("size > 1")
    # in a class of k rows or fewer every other row is a neighbour
    kth = F.least(F.lit(k), F.col("size") - 1).cast("int")
    measured = near.withColumns({"k": kth, "d": F.get("near", kth - 1)}).drop("near")
    measured = materialize(measured, "neighbour-distances")

    tied = F.col("d") == 0
    high = F.struct((F.col("x") + F.col("d")).alias("v"), F.when(tied, UP_TO).otherwise(BELOW).alias("kind"), F.lit(1).alias("sign"))
    low = F.struct((F.col("x") - F.col("d")).alias("v"), F.when(tied, BELOW).otherwise(UP_TO).alias("kind"), F.lit(-1).alias("sign"))
    value = F.struct(F.col("x").alias("v"), F.lit(VALUE).alias("kind"), F.lit(0).alias("sign"))
    events = measured.select("feature", "row", F.inline(F.array(high, low, value)))
    counted = sorted_running(
        events, ["feature"], [F.col("v"), F.col("kind"), F.col("row"), F.col("sign")],
        {"upto": (F.col("kind") == VALUE).cast("bigint")}, "neighbour-events",
    )
    within = counted.where("sign <> 0").groupBy("feature", "row").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    exact = "decimal(28,15)"  # sums do not depend on the order of rows

    def mean(c: Column) -> Column:
        return F.sum(c.cast(exact)).cast("double") / F.count("*")

    by_m = within.groupBy("feature", "m").agg(F.count("*").alias("n")).groupBy("feature").agg(
        (F.sum((digamma(F.col("m")) * F.col("n")).cast(exact)).cast("double") / F.sum("n")).alias("psi_m")
    )
    own = measured.groupBy("feature").agg(
        digamma(F.count("*")).alias("psi_n"), mean(digamma(F.col("k"))).alias("psi_k"), mean(digamma(F.col("size"))).alias("psi_class")
    )
    score = F.greatest(F.lit(0.0), F.col("psi_n") + F.col("psi_k") - F.col("psi_class") - F.col("psi_m"))
    return own.join(by_m, "feature").select("feature", score.alias("score"))
