"""Whitening of embeddings on exact principal components.

Entries c become whole numbers floor(64 c), so sums and products are exact in any order. The fit list is each distinct
vector once. Tasks sum the products of their rows (20-bit halves in float64 blocks small enough to stay exact), Spark
adds the cells, and the driver holds one d x d integer scatter n * sum(x x') - S S', whose size follows from the
dimension alone. Its characteristic polynomial comes from Spark tasks, one prime each, and Chinese remaindering; the
largest roots are isolated on the driver, and their null spaces found by inverse iteration in tasks, one root each
(``charpoly``). Rows are then centred exactly and projected in tasks.

The offset of the query's x = floor(64 c) + 1000000 drops out of every centred figure, so it is never added.

Defined results: rows whose vector is null, empty or holds a null, non-finite or larger entry than ``MAX_ENTRY`` in size
are left out; so are vectors of another length than the commonest one (of equals, the longer); a null vec_id is a row
like others, repeated rows each get their rows; components without variance are left out, so a single distinct vector
or an empty table gives no rows; a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import charpoly
from wardlake.session import materialize

SCALE = 64
COMPONENTS = 16
MAX_ENTRY = 2.0**34
# 4096 rows of products of 20-bit halves sum to 2^52 at most, which float64 holds exactly.
HALF_BITS = 20
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What rows are centred and projected with: the same for all rows."""

    n: int
    sums: tuple[int, ...]
    # per component: eigenvalue, share of the trace, unit vector
    values: tuple[float, ...]
    explained: tuple[float, ...]
    vectors: np.ndarray

    def centred(self, q: np.ndarray) -> np.ndarray:
        """q - S / n with one rounding: the whole part of S / n is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (q - whole) - rest

    def deviations(self, q: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n q - S)^2, exact."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        moved = q - whole
        largest = int(abs(moved).max(initial=0)) * self.n + self.n
        if largest * largest * max(1, q.shape[1]) < 2**63:
            scaled = moved * self.n - rest
            return (scaled * scaled).sum(axis=1).tolist()
        scaled = moved.astype(object) * self.n - rest.astype(object)
        return [int(x) if x < 2**63 else None for x in (scaled * scaled).sum(axis=1)]

    def whitened(self, q: np.ndarray) -> np.ndarray:
        return self.centred(q) @ self.vectors.T / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q): the vectors that take part, entries floor(64 c)."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MAX_ENTRY)
    vectors = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    whole = usable.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("q"))
    stored = materialize(whole, "whole-vectors")
    common = stored.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored.where(F.size("q") == (common.d if common else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("q"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _block_products(q: np.ndarray) -> np.ndarray:
    """q' q in exact integers."""
    size = abs(q)
    low = np.sign(q) * (size & ((1 << HALF_BITS) - 1))
    high = np.sign(q) * (size >> HALF_BITS)
    halves = [low.astype(float)] + ([high.astype(float)] if high.any() else [])
    total = np.zeros((q.shape[1], q.shape[1]), dtype=object)
    for i, a in enumerate(halves):
        for j, b in enumerate(halves):
            total += (a.T @ b).astype(np.int64).astype(object) << (HALF_BITS * (i + j))
    return total


def _scatter_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, total) of a task: the upper triangle of q' q, the sums of q, the number of rows."""
    n, sums, products = 0, None, None
    for batch in batches:
        whole = _matrix(batch)
        for at in range(0, len(whole), BLOCK_ROWS):
            q = whole[at : at + BLOCK_ROWS]
            block, own = _block_products(q), q.sum(axis=0).astype(object)
            n, sums, products = n + len(q), own if sums is None else sums + own, block if products is None else products + block
    if n:
        upper = np.triu_indices(len(sums))
        cells = [*products[upper], *sums, n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(cells)), pa.int64()), pa.array([Decimal(int(c)) for c in cells], pa.decimal128(38, 0))],
            ["cell", "total"],
        )


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * sum(x x') - S S' over the rows of ``fit``."""
    cells = fit.select("q").mapInArrow(_scatter_cells, "cell bigint, total decimal(38,0)")
    found = {r.cell: int(r.total) for r in cells.groupBy("cell").agg(F.sum("total").alias("total")).collect()}
    rows, columns = np.triu_indices(d)
    edge = len(rows)
    sums, n = [found[edge + i] for i in range(d)], found[edge + d]
    matrix = [[0] * d for _ in range(d)]
    for cell, (i, j) in enumerate(zip(rows.tolist(), columns.tolist())):
        matrix[i][j] = matrix[j][i] = n * found[cell] - sums[i] * sums[j]
    return n, sums, matrix


def _polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    chosen = charpoly.needed_primes(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [chosen[i] for i in batch.column(0).to_pylist()]
            found = [charpoly.polynomial_mod(matrix, p) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, len(chosen), 1, tasks).mapInArrow(residues, "p bigint, c array<bigint>").collect()
    return charpoly.remaindered([(r.p, r.c) for r in sorted(found)])


def _components(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[list[float]]:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [charpoly.null_vectors(matrix, *roots[i]) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["i", "v"])

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(vectors, "i bigint, v array<array<double>>").collect()
    return [v for r in sorted(found) for v in r.v]


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of ``fit`` (q), divisor n; None where there is no variance."""
    spark = fit.sparkSession
    n, sums, matrix = scatter(fit, d)
    common = math.gcd(*[c for row in matrix for c in row])
    if not common:
        return None
    matrix = [[c // common for c in row] for row in matrix]
    trace = sum(matrix[i][i] for i in range(d))
    roots = charpoly.largest_roots(_polynomial(spark, matrix), components, trace)
    exact = [(root, shift) for root, shift, many in roots for _ in range(many)][:components]
    values = tuple(root * common / (n * n << shift) for root, shift in exact)
    explained = tuple(root / (trace << shift) for root, shift in exact)
    vectors = np.array(_components(spark, matrix, roots)[: len(exact)])
    return Whitening(n, tuple(sums), values, explained, vectors)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows of ``fit`` minus the identity."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch))
                totals += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int64()), pa.array(totals)], ["cell", "total"])

    cells = fit.select("q").mapInArrow(moments, "cell bigint, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    totals = np.array([r.total for r in sorted(cells.collect())]) / model.n
    means = totals[k * k :]
    covariance = totals[: k * k].reshape(k, k) - np.outer(means, means)
    return float(abs(covariance - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row of ``vectors`` (vec_id, q)."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch)
                w = pa.array(model.whitened(q).tolist(), pa.list_(pa.float64()))
                ids = batch.column(batch.schema.get_field_index("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.deviations(q), pa.int64()), w], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(project, "vec_id bigint, deviation bigint, whitened array<double>")


def judged(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows)
    first = vectors.first()
    d = len(first.q) if first else 0
    fit = materialize(vectors.select("q").distinct(), "fit-vectors")
    model = fit_whitening(fit, d, components) if d else None
    if model is None:
        nothing = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], nothing)
    error = identity_error(fit, model)
    explained = F.array(*[F.lit(e) for e in model.explained])
    long = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
