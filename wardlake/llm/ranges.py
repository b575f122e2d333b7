"""Ordered blocks of about equal weight over an integer key, whatever its values, independent of how rows are dealt.

A histogram over equal key ranges is refined where it is too coarse: a range that weighs more than a block is cut again
between its smallest and largest key, until it fits or holds one key only; rows of one key are then cut by a second
integer, the tie. So far outliers, a third of all rows without a key, or one key for all rows still give blocks of the
wanted weight; only rows equal in key and tie stay together. Every round reads keys and weights alone. The ranges of all
rounds, about ``FINENESS * MAX_BLOCKS`` at most, are all that reaches the driver and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# More blocks than this are never made: blocks grow instead.
MAX_BLOCKS = 32_768
# Ranges per wanted block in a histogram.
FINENESS = 4
# From this span on keys are shifted before they are subtracted, so that no difference leaves a long.
WIDE_SPAN = 1 << 61

_LEVEL = (
    "__range int, __bucket int, __block int, __opens boolean, __first_key bigint, __first_tie bigint, "
    "__inner int, __inner_by_tie boolean, __inner_low bigint, __inner_shift int, __inner_width bigint"
)

# What a range's buckets are found with.
_PARAMS = (("number", "int"), ("by_tie", "boolean"), ("low", "bigint"), ("shift", "int"), ("width", "bigint"))


@dataclass
class _Range:
    """A range of keys, or of ties of one key, cut into buckets of equal width."""

    number: int
    by_tie: bool
    low: int
    shift: int
    width: int
    # bucket -> smallest key, smallest tie, weight
    buckets: dict[int, tuple[int | None, int, int]] = field(default_factory=dict)
    inner: dict[int, _Range] = field(default_factory=dict)

    @classmethod
    def over(cls, number: int, by_tie: bool, low: int, high: int, buckets: int) -> _Range:
        shift = 2 if high - low >= WIDE_SPAN else 0
        width = -(-((high >> shift) - (low >> shift) + 1) // max(2, buckets))
        return cls(number, by_tie, low, shift, max(1, width))

    def params(self) -> tuple[int, bool, int, int, int]:
        return self.number, self.by_tie, self.low, self.shift, self.width

    def leaves(self) -> Iterator[tuple[_Range, int]]:
        for bucket in sorted(self.buckets):
            if bucket in self.inner:
                yield from self.inner[bucket].leaves()
            else:
                yield self, bucket


def _found(rows: DataFrame, key: Column, tie: Column, ranges: Column) -> DataFrame:
    """Add ``__bucket`` of the current range; ``ranges`` is a struct of its parameters."""
    value = F.when(ranges.by_tie, tie).otherwise(key)
    low, wide = ranges.low, ranges["shift"] > 0
    near = F.call_function("div", F.when(~wide, value) - F.when(~wide, low), ranges.width)
    far = F.call_function("div", F.shiftright(value, 2) - F.shiftright(low, 2), ranges.width)
    return rows.withColumn("__bucket", F.when(wide, far).otherwise(near).cast("int"))


@dataclass(frozen=True)
class Blocks:
    """How (key, tie) maps to blocks 0, 1, ... in their order; rows without a key come first, in the order of ties."""

    spark: SparkSession
    roots: list[tuple[int, bool, int, int, int]]
    levels: list[list[tuple]]
    n_blocks: int

    @classmethod
    def of(cls, df: DataFrame, key: str, tie: str, weight: Column, block_weight: int) -> Blocks:
        """``df`` is read once per round of refinement, two or three times as a rule; it should be a narrow table."""
        rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(tie).alias("tie"), weight.cast("bigint").alias("weight"))
        unkeyed = F.when(F.col("key").isNull(), F.col("tie"))
        total, low, high, low_tie, high_tie = rows.agg(
            F.sum("weight"), F.min("key"), F.max("key"), F.min(unkeyed), F.max(unkeyed)
        ).first()
        most = max(1, block_weight, -(-(total or 0) // MAX_BLOCKS))

        def share(w: int) -> int:
            return FINENESS * -(-w // most)

        level = [_Range.over(0, True, low_tie or 0, high_tie or 0, share(total or 0))]
        level += [_Range.over(1, False, low or 0, high or 0, share(total or 0))]
        top, number, tables = list(level), 2, []
        while level:
            blocks = cls(df.sparkSession, [r.params() for r in top], tables, 0)
            at = {r.number: r for r in level}
            seen = blocks._walk(rows, F.col("key"), F.col("tie")).where("__ranges IS NOT NULL")
            histogram = _found(seen, F.col("key"), F.col("tie"), F.col("__ranges")).groupBy("__ranges.number", "__bucket").agg(
                F.sum("weight"), F.min("key"), F.max("key"), F.min("tie"), F.max("tie")
            )
            level = []
            for n, bucket, weighs, key_low, key_high, tie_low, tie_high in histogram.collect():
                own = at[n]
                own.buckets[bucket] = key_low, tie_low, weighs
                by_tie = own.by_tie or key_low == key_high
                low, high = (tie_low, tie_high) if by_tie else (key_low, key_high)
                if weighs > most and low < high:
                    own.inner[bucket] = _Range.over(number, by_tie, low, high, share(weighs))
                    level.append(own.inner[bucket])
                    number += 1
            tables.append(cls._table(at.values()))
        return cls._numbered(df.sparkSession, top, len(tables), most)

    @staticmethod
    def _table(ranges, places: dict | None = None) -> list[tuple]:
        """Rows of one level: where a bucket is cut further, or, once blocks are numbered, which block it is in."""
        out = []
        for r in ranges:
            for bucket, (key, tie, _) in sorted(r.buckets.items()):
                inner = r.inner.get(bucket)
                block, opens = (None, None) if places is None or inner else places[r.number, bucket]
                further = inner.params() if inner else (None,) * 5
                out.append((r.number, bucket, block, opens, key, tie if r.by_tie else None, *further))
        return out

    @classmethod
    def _numbered(cls, spark: SparkSession, top: list[_Range], depth: int, most: int) -> Blocks:
        places, block, filled = {}, -1, most
        for r, bucket in (leaf for root in top for leaf in root.leaves()):
            opens = filled >= most
            if opens:
                block, filled = block + 1, 0
            filled += r.buckets[bucket][2]
            places[r.number, bucket] = block, opens
        levels, ranges = [], top
        for _ in range(depth):
            levels.append(cls._table(ranges, places))
            ranges = [i for r in ranges for i in r.inner.values()]
        return cls(spark, [r.params() for r in top], levels, block + 1)

    def _walk(self, rows: DataFrame, key: Column, tie: Column) -> DataFrame:
        """Add ``__ranges``, the range of the last level that a row came to (null if it has its block), and ``__place``,
        the block it has with what tells the block's first rows."""
        unkeyed, keyed = (F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, _PARAMS)]) for r in self.roots)
        rows = rows.withColumn("__ranges", F.when(key.isNull(), unkeyed).otherwise(keyed))
        rows = rows.withColumn("__place", F.lit(None).cast("struct<block:int,opens:boolean,first_key:bigint,first_tie:bigint>"))
        for level in self.levels:
            here = F.struct(*[F.col(f"__{n}").alias(n) for n in ("block", "opens", "first_key", "first_tie")])
            further = F.struct(F.col("__inner").alias("number"), *[F.col(f"__inner_{n}").alias(n) for n, _ in _PARAMS[1:]])
            table = self.spark.createDataFrame(level, _LEVEL).select(
                "__range",
                "__bucket",
                F.when(F.col("__block").isNotNull(), here).alias("__here"),
                F.when(F.col("__inner").isNotNull(), further).alias("__next"),
            )
            at = _found(rows, key, tie, F.col("__ranges")).withColumn("__range", F.col("__ranges.number"))
            joined = at.join(F.broadcast(table), ["__range", "__bucket"], "left")
            rows = joined.withColumns({"__ranges": F.col("__next"), "__place": F.coalesce("__place", "__here")})
            rows = rows.drop("__range", "__bucket", "__here", "__next")
        return rows

    def add(self, df: DataFrame, key: str, tie: str) -> DataFrame:
        """Add ``block``, ``block_before`` (the one before; for block 0 the last) and ``leads``: whether the row is one
        of those with the smallest key, and tie if the key is cut, of its block."""
        here = self._walk(df, F.col(key), F.col(tie))
        place = F.col("__place")
        first = F.col(key).eqNullSafe(place.first_key) & (place.first_tie.isNull() | (F.col(tie) == place.first_tie))
        before = F.when(place.block == 0, F.lit(self.n_blocks - 1)).otherwise(place.block - 1)
        out = here.withColumns({"block": place.block, "block_before": before, "leads": place.opens & first})
        return out.drop("__ranges", "__place")

    def deal(self, df: DataFrame) -> DataFrame:
        """Every block to a task of its own."""
        return df.repartitionById(max(1, self.n_blocks), F.col("block"))
