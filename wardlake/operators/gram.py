"""Pairwise-complete correlations from blocked Gram matrices, in one scan for any number of columns.

With X the shifted values (0 where missing) and M the 0/1 marks of what is present, the products X'X, X'M, (X*X)'M and
M'M hold all that the correlation of every pair over the rows where both are present needs. Every task multiplies its
rows block by block and hands out one number per cell; Spark adds the cells. Columns are shifted by a mean of some first
rows, which leaves the correlation as it is and keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that the shift of a column is taken from.
SHIFT_ROWS = 1000
# Below this share of the sum of squares, what is left of a variance is rounding: the column does not vary.
FLAT = 1e-12
PRODUCTS = ("n", "sx", "sxx", "sxy")


def _cells(numbers: DataFrame, width: int, shift: list[float]) -> DataFrame:
    """(i, j, n, sx, sxx, sxy) summed over all rows: sx and sxx of column i where j is present too."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(PRODUCTS), width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x - shift, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                for at, product in enumerate((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)):
                    totals[at] += product
        cells = np.arange(width * width)
        columns = [pa.array(cells // width, pa.int32()), pa.array(cells % width, pa.int32())]
        columns += [pa.array(t.ravel()) for t in totals]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", *PRODUCTS])

    schema = "i int, j int, " + ", ".join(f"{p} double" for p in PRODUCTS)
    return numbers.mapInArrow(multiply, schema).groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in PRODUCTS])


def correlations(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """(column_x, column_y, r) for all ordered pairs of the named number columns.

    Rows where either is missing (NULL or NaN) don't count for a pair; r is NULL where one of the two does not vary over
    the rows that count or is infinite in any.
    """
    names = [name for name, _ in columns]
    numbers = df.select(*[c.cast("double").alias(f"c{i}") for i, (_, c) in enumerate(columns)])
    finite = [F.avg(F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))) for i in range(len(names))]
    shift = [float(x or 0.0) for x in numbers.limit(SHIFT_ROWS).agg(*finite).first()]
    cells = _cells(numbers, len(names), shift)
    # the other column of the pair over the same rows
    other = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    met = cells.join(other, ["i", "j"])
    n = F.nullif("n", F.lit(0.0))
    vary_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vary_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    together = F.col("sxy") - F.col("sx") * F.col("sy") / n
    usable = (vary_x > FLAT * F.col("sxx")) & (vary_y > FLAT * F.col("syy")) & ~F.isnan(together)
    r = F.when(usable & ~F.isnan(vary_x) & ~F.isnan(vary_y), together / F.sqrt(vary_x) / F.sqrt(vary_y))
    listed = F.array(*[F.lit(name) for name in names])
    return met.select(F.get(listed, F.col("i")).alias("column_x"), F.get(listed, F.col("j")).alias("column_y"), r.alias("r"))
