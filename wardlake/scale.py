"""Building blocks that keep a hot key from landing in one task.

* ``running``: per-key running aggregates in two levels. Rows are grouped into ordered buckets
  inside the key; a window over the (small) bucket totals gives the carry, a window inside each
  bucket gives the rest. The widest task sees one bucket, not one key.
* ``row_numbers``: the same for ``row_number``.
* ``sorted_running``: the same without a bucket column: the rows are range-sorted and the partitions are the buckets.
* ``exact_quantiles``: interpolated quantiles in two scans, without one task holding every value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wardlake.session import materialize

# Values that the `percentile` buffers of one aggregation, over all its columns together, may hold; above, values are
# counted inside brackets.
MAX_QUANTILE_STATE = 1_000_000
# A rank sketch is off by at most one in so many rows; brackets are wider by this factor.
SKETCH_ACCURACY, SKETCH_MARGIN = 5_000, 3.0
# Ordered buckets that the distinct values inside one bracket are spread over.
ZONE_BUCKETS = 64


def one_row(df: DataFrame) -> Column:
    """A one-row, one-column frame as a scalar subquery."""
    return df.scalar()


def fits_rows(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; stops reading once the limit is passed."""
    return df.limit(limit + 1).count() <= limit


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums per key, ordered by (bucket, order).

    ``bucket`` must never decrease along ``order`` and ``order`` must be unique inside a bucket.
    ``totals`` adds whole-key sums, computed from the bucket totals, so they cost no extra pass.
    ``xors`` adds running exclusive-ors of integers.
    """
    totals, xors = dict(totals or {}), dict(xors or {})
    keyed = df.withColumn("__bucket", bucket)
    group = [*keys, "__bucket"]
    parts = keyed.groupBy(*group).agg(
        *[F.sum(c).alias(f"__part_{n}") for n, c in sums.items()],
        *[F.sum(c).alias(f"__all_{n}") for n, c in totals.items()],
        *[F.bit_xor(c).alias(f"__part_{n}") for n, c in xors.items()],
    )
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = parts.select(
        *group,
        *[F.coalesce(F.sum(f"__part_{n}").over(before), F.lit(0)).alias(f"__carry_{n}") for n in sums],
        *[F.sum(f"__all_{n}").over(whole).alias(n) for n in totals],
        *[F.coalesce(F.bit_xor(f"__part_{n}").over(before), F.lit(0)).alias(f"__carry_{n}") for n in xors],
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.select(
        "*",
        *[F.sum(c).over(inside).alias(f"__in_{n}") for n, c in sums.items()],
        *[F.bit_xor(c).over(inside).alias(f"__in_{n}") for n, c in xors.items()],
    )
    joined = null_safe_join(local, carry, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"__carry_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums],
        *[F.col(n) for n in totals],
        *[F.col(f"__carry_{n}").bitwiseXOR(F.col(f"__in_{n}")).alias(n) for n in xors],
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` per key (and optionally the key's row count) in two levels."""
    one = F.lit(1).cast("bigint")
    return running(df, keys, bucket, order, {name: one}, {total: one} if total else None)


def sorted_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    name: str = "sorted",
) -> DataFrame:
    """Add inclusive running sums per key along ``order``, and ``__part``, the range partition of the row.

    The rows are range-partitioned by (keys, order), so a hot key spreads over as many tasks as its rows need and only
    rows equal in all of ``order`` must share one; they are written once, so that every later use sees the same
    partitions. Then the totals of each (key, partition) carry over as in ``running``. Null keys are a key like others.
    """
    part = F.spark_partition_id()
    laid = materialize(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", part), name)
    return running(laid, keys, F.col("__part"), order, sums)


# --- exact quantiles from rank sketches ----------------------------------------------------------


def _edges(probs: Sequence[float]) -> list[tuple[float | None, float | None]]:
    """Per probability the shares between which a sketch surely places it; None is open."""
    margin = SKETCH_MARGIN / SKETCH_ACCURACY
    return [(p - margin if p > margin else None, p + margin if p < 1 - margin else None) for p in probs]


def _sketches(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Per column the rank sketch read at all edges (an array) and the number of values."""
    at = sorted({e for pair in _edges(probs) for e in pair if e is not None} | {0.5})
    shares = F.array(*[F.lit(e) for e in at])
    return [F.approx_percentile(c, shares, F.lit(SKETCH_ACCURACY)).alias(f"__sketch{i}") for i, c in enumerate(columns)] + [
        F.count(c).alias(f"__n{i}") for i, c in enumerate(columns)
    ]


def _bracket_columns(probs: Sequence[float], sketch: Column) -> list[tuple[Column, Column]]:
    """Per probability the values (low, high) that bracket it; infinite where it is open."""
    at = sorted({e for pair in _edges(probs) for e in pair if e is not None} | {0.5})
    read = {e: sketch[i] for i, e in enumerate(at)}
    return [
        (F.lit(float("-inf")) if low is None else read[low], F.lit(float("inf")) if high is None else read[high])
        for low, high in _edges(probs)
    ]


def rank_cells(
    df: DataFrame, brackets: Mapping[str, tuple[Column, Sequence[tuple[Column, Column]]]], groups: Sequence[str] = ()
) -> DataFrame:
    """Counts ``(groups..., column, zone, value, n)`` of one scan: values inside a bracket one by one, the others by zone.

    ``brackets`` has per column its value and the brackets, which must not fall from one to the next. Zone 2i+1 is inside bracket i, zone 2i before it; ``value``
    is NULL outside. Written once, as it is small and read several times.
    """
    records = []
    for name, (value, pairs) in brackets.items():
        zone = F.lit(2 * len(pairs))
        for i in range(len(pairs) - 1, -1, -1):
            low, high = pairs[i]
            within = (value <= high) | (high == float("inf"))
            zone = F.when(value < low, F.lit(2 * i)).when(within, F.lit(2 * i + 1)).otherwise(zone)
        records.append(F.struct(F.lit(name).alias("column"), zone.alias("zone"), value.alias("value")))
    long = df.select(*groups, F.inline(F.filter(F.array(*records), lambda r: r.value.isNotNull())))
    kept = F.when(F.col("zone") % 2 == 1, F.col("value")).alias("value")
    cells = long.select(*groups, "column", "zone", kept).groupBy(*groups, "column", "zone", "value")
    return materialize(cells.agg(F.count("*").alias("n")), "rank-cells")


def quartile_brackets(df: DataFrame, columns: Sequence[str], factor: float) -> tuple[list[list[tuple[float, float]]], Row]:
    """Per column the brackets of both quartiles and of the bounds ``factor`` quartile distances away, joined where they
    overlap; none where there is no value. Beside them the row of that scan, with n, lo and hi per column."""
    head = df.agg(
        *_sketches(columns, [0.25, 0.75]),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    at = sorted({e for pair in _edges([0.25, 0.75]) for e in pair} | {0.5})
    out = []
    for i in range(len(columns)):
        if not head[f"n{i}"]:
            out.append([])
            continue
        read = dict(zip(at, head[f"__sketch{i}"]))
        (a, b), (c, d) = [(read[low], read[high]) for low, high in _edges([0.25, 0.75])]
        f = factor
        # what rounding may move
        slack = 1e-9 * max(abs(a), abs(d)) * (1 + f)
        spans = [(a, b), (c, d), ((1 + f) * a - f * d, (1 + f) * b - f * c), ((1 + f) * c - f * b, (1 + f) * d - f * a)]
        joined: list[tuple[float, float]] = []
        for low, high in sorted((lo - slack, hi + slack) for lo, hi in spans):
            if joined and low <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(joined[-1][1], high)
            else:
                joined.append((low, high))
        out.append(joined)
    return out, head


def quantiles_of_cells(cells: DataFrame, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles ``(groups..., column, q)`` from the counts of ``rank_cells``."""
    key = [*groups, "column"]
    # inside a bracket distinct values are spread over ordered buckets by their share of the way from 0 to its end
    spans = cells.groupBy(*key, "zone").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    spread = null_safe_join(cells, spans, [*key, "zone"])
    way = (F.col("value") / 2 - F.col("__lo") / 2) / F.nullif(F.col("__hi") / 2 - F.col("__lo") / 2, F.lit(0.0))
    part = F.coalesce(F.least(F.floor(way * ZONE_BUCKETS), F.lit(ZONE_BUCKETS - 1)), F.lit(0))
    bucket = F.col("zone") * ZONE_BUCKETS + part
    counted = running(
        spread.select(*key, "zone", "value", "n", bucket.cast("bigint").alias("__at")), key, F.col("__at"), [F.col("value")],
        {"upto": F.col("n")}, {"total": F.col("n")},
    )
    ranked = counted.withColumn("from", F.col("upto") - F.col("n"))
    positions = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("from") <= rank) & (rank < F.col("upto")), F.col("value")))

    picked = ranked.groupBy(*key).agg(
        F.first("total").alias("total"),
        *[at(F.floor(p)).alias(f"lo{i}") for i, p in enumerate(positions)],
        *[at(F.ceil(p)).alias(f"hi{i}") for i, p in enumerate(positions)],
    )

    def interpolated(i: int) -> Column:
        pos = positions[i]
        low, high = F.floor(pos), F.ceil(pos)
        missed = F.col(f"lo{i}").isNull() | F.col(f"hi{i}").isNull()
        value = F.when(low == high, F.col(f"lo{i}")).otherwise(
            (high - pos) * F.col(f"lo{i}") + (pos - low) * F.col(f"hi{i}")
        )
        return F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(value)

    return picked.select(*key, F.array(*[interpolated(i) for i in range(len(probs))]).alias("q"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    groups: Sequence[str] = (),
    max_state: int = MAX_QUANTILE_STATE,
) -> DataFrame:
    """Interpolated quantiles of numeric ``columns``: rows ``(groups..., column, q ARRAY<DOUBLE>)``, in two scans.

    The first makes a mergeable rank sketch per column and group, which brackets every wanted rank. Up to ``max_state``
    values the built-in ``percentile`` then holds them all; above, the second scan counts what lies inside the brackets,
    a few thousandths of the rows, value by value and the rest by zone (``rank_cells``). Both ways are exact.
    """
    columns = list(columns)
    values = [f"__v{i}" for i in range(len(columns))]
    numeric = df.select(*groups, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)])
    sketched = numeric.groupBy(*groups).agg(*_sketches(values, probs))
    if groups:
        sketched = materialize(sketched, "rank-sketches")
        known = sketched.agg(*[F.sum(f"__n{i}") for i in range(len(columns))]).first()
    else:
        head = sketched.first()
        known = [head[f"__n{i}"] for i in range(len(columns))]
    if sum(n or 0 for n in known) <= max_state:
        shares = F.array(*[F.lit(float(p)) for p in probs])
        held = [F.struct(F.lit(c).alias("column"), F.percentile(v, shares).alias("q")) for c, v in zip(columns, values)]
        return numeric.groupBy(*groups).agg(F.array(*held).alias("__held")).select(*groups, F.inline("__held"))
    order = sorted({float(p) for p in probs})
    if groups:
        numeric = null_safe_join(numeric, sketched.drop(*[f"__n{i}" for i in range(len(columns))]), groups)
        sketches = [F.col(f"__sketch{i}") for i in range(len(columns))]
    else:
        sketches = [F.array(*[F.lit(x) for x in head[f"__sketch{i}"] or []]) for i in range(len(columns))]
    brackets = {c: (F.col(v), _bracket_columns(order, k)) for c, v, k, n in zip(columns, values, sketches, known) if n}
    return quantiles_of_cells(rank_cells(numeric, brackets, groups), probs, groups)


def quantile_scalar(df: DataFrame, column: str, prob: float) -> Column:
    """One exact quantile of a column as a scalar subquery."""
    return one_row(exact_quantiles(df, [column], [prob]).select(F.col("q")[0].alias("q")))
