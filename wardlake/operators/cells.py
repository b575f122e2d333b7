"""Exact top-k search in a store of vectors laid out by tenant and cell.

A tenant's vectors are dealt to cells, each around a centre; centres are chosen far from each other among vectors drawn
by hash, four for each. A cell knows its centre, its radius and how many vectors it holds. By the triangle inequality no vector of a cell scores more against a
query q than q.centre + |q| radius. A search goes in two scans:

1. per query the cells of highest bound that hold k vectors together are scored: their k-th score is a floor;
2. every cell whose bound reaches the query's floor is scored; the others can't hold one of the best k.

Both scans read only the folders of the queries' tenants and, by the order of rows in the files, little more than the
wanted cells; tasks multiply a cell's vectors with the queries that want it and hand on k rows per query. The result is
the one of a full comparison, ties included.

The driver holds the drawn vectors (at most four for each of ``MAX_CENTRES``) and, per tenant that is asked about, one bound per query and
cell. Tenants too small for two cells are one cell around zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.operators.retrieval import CANDIDATES, MAX_BROADCAST_QUERIES, SCORE_DIGITS, SLAB, BestRows
from wardlake.operators.selection import first_per_group
from wardlake.session import materialize

# Vectors wanted per cell, and centres over all tenants together.
CELL_ROWS = 1_024
MAX_CENTRES = 4_096
# Vectors drawn per centre.
DRAWN = 4
# Cells named in a scan's filter; with more, a scan reads the tenants' folders whole.
MAX_NAMED_CELLS = 2_000
# Bounds may be short by rounding, relative to |q| (|centre| + radius).
SLACK = 1e-9
# Folder names are never empty, so that the empty text is a tenant like others.
FOLDER = "t"


@dataclass(frozen=True)
class Search:
    """What was found, (query_id, item_id, score, rank), and how many products of a vector and a query it took."""

    found: DataFrame
    scored_pairs: int
    all_pairs: int


def _folder(tenant: str | None) -> Column:
    return F.concat(F.lit(FOLDER), F.col(tenant).cast("string") if tenant else F.lit(""))


def _spread(drawn: np.ndarray, cells: int) -> np.ndarray:
    """``cells`` of the drawn vectors, each the farthest from those taken before: that keeps the largest radius small."""
    taken = [0]
    away = ((drawn - drawn[0]) ** 2).sum(axis=1)
    while len(taken) < cells and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, ((drawn - drawn[taken[-1]]) ** 2).sum(axis=1))
    return drawn[taken]


def _centres(items: DataFrame, cell_rows: int, max_centres: int) -> dict[str, np.ndarray]:
    """Per tenant of two cells or more its centres; a tenant's share of all centres follows its rows."""
    sizes = items.groupBy("tenant").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    step = max(cell_rows, -(-total // max(1, max_centres)))
    wanted = sizes.select("tenant", F.floor(F.col("n") / step).cast("int").alias("cells")).where("cells >= 2")
    # a thin draw by hash first, so that only a few rows per centre are ranked
    draw = F.pmod(F.xxhash64("ident"), F.lit(step)) < 2 * DRAWN
    order = Window.partitionBy("tenant").orderBy(F.xxhash64("ident", F.lit("centre")), "ident")
    ranked = items.where(draw).join(wanted, "tenant").withColumn("place", F.row_number().over(order))
    out: dict[str, list] = {}
    cells: dict[str, int] = {}
    for row in ranked.where(F.col("place") <= F.col("cells") * DRAWN).collect():  # at most DRAWN * max_centres rows
        out.setdefault(row.tenant, []).append(row.vec)
        cells[row.tenant] = row.cells
    return {tenant: _spread(np.array(rows, dtype=np.float64), cells[tenant]) for tenant, rows in out.items()}


def write_cells(
    vectors: DataFrame,
    path: str,
    tenant: str | None = None,
    vector_id: str = "chunk_id",
    embedding: str = "embedding",
    cell_rows: int = CELL_ROWS,
    max_centres: int = MAX_CENTRES,
) -> None:
    """Write the store under ``path``. Rows without vector or tenant are left out: no query may see them."""
    spark = vectors.sparkSession
    items = vectors.select(
        _folder(tenant).alias("tenant"), F.col(vector_id).alias("ident"), F.col(embedding).cast("array<double>").alias("vec")
    ).where("vec IS NOT NULL AND tenant IS NOT NULL")
    items = materialize(items, "cell-items")
    centres = spark.sparkContext.broadcast(_centres(items, cell_rows, max_centres))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for name, all_rows in batch.groupby("tenant").indices.items():
                for at in range(0, len(all_rows), SLAB):
                    rows = all_rows[at : at + SLAB]
                    x = np.stack(batch["vec"].to_numpy()[rows])
                    own = centres.value.get(name, np.zeros((1, x.shape[1])))
                    cell[rows] = ((own * own).sum(axis=1)[None, :] - 2.0 * x @ own.T).argmin(axis=1)
                    away[rows] = np.sqrt(((x - own[cell[rows]]) ** 2).sum(axis=1))
            yield batch.assign(cell=cell, away=away)

    kinds = dict(items.dtypes)
    dealt = items.mapInPandas(assign, f"tenant string, ident {kinds['ident']}, vec array<double>, cell int, away double")
    dealt = materialize(dealt, "cell-dealt")
    dealt.select("ident", "vec", "cell", "tenant").repartitionByRange("tenant", "cell", F.xxhash64("ident")).sortWithinPartitions(
        "tenant", "cell"
    ).write.mode("overwrite").partitionBy("tenant").parquet(f"{path}/vectors")
    cells = dealt.groupBy("tenant", "cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), F.min("ident").alias("first_ident")
    )
    known = [(t, i, c.tolist()) for t, rows in centres.value.items() for i, c in enumerate(rows)]
    at = spark.createDataFrame(known, "tenant string, cell int, centre array<double>")
    cells.join(at, ["tenant", "cell"], "left").write.mode("overwrite").parquet(f"{path}/cells")


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ident, vec, cell, tenant); tenants are text, whatever they look like."""
    kind = dict(spark.read.parquet(f"{path}/cells").dtypes)["first_ident"]
    return spark.read.schema(f"ident {kind}, vec array<double>, cell int, tenant string").parquet(f"{path}/vectors")


@dataclass
class _Asked:
    """Queries of one tenant: their places among all, and bounds against the tenant's cells."""

    places: np.ndarray
    cells: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray

    def nearest(self, k: int) -> np.ndarray:
        """Per query and cell whether the cell is among those of highest bound that hold k vectors together."""
        order = np.argsort(-self.bounds, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        wanted = np.zeros(self.bounds.shape, dtype=bool)
        np.put_along_axis(wanted, order, held < k, axis=1)
        return wanted


def _asked(spark: SparkSession, path: str, matrix: np.ndarray, tenants: np.ndarray) -> dict[str, _Asked]:
    cells = spark.read.parquet(f"{path}/cells").where(F.col("tenant").isin(sorted(set(tenants)))).toPandas()
    out = {}
    for name, own in cells.sort_values("cell").groupby("tenant"):
        places = np.flatnonzero(tenants == name)
        q = matrix[places]
        centre = np.stack([np.asarray(c) if isinstance(c, (list, np.ndarray)) else np.zeros(q.shape[1]) for c in own["centre"]])
        reach = np.sqrt((q * q).sum(axis=1))[:, None]
        radius = own["radius"].to_numpy()[None, :]
        slack = SLACK * reach * (np.sqrt((centre * centre).sum(axis=1))[None, :] + radius) + 10.0**-SCORE_DIGITS
        bounds = q @ centre.T + reach * radius + slack
        out[name] = _Asked(places, own["cell"].to_numpy(), own["n"].to_numpy(), bounds)
    return out


def _scan(store: DataFrame, matrix: np.ndarray, wanted: dict[tuple[str, int], np.ndarray], k: int) -> DataFrame:
    """(place, item_id, score): k rows per query and task from the wanted cells."""
    shared = store.sparkSession.sparkContext.broadcast((matrix, wanted))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, cells = shared.value
        best = BestRows(len(queries), k)
        for batch in batches:
            for key, rows in batch.groupby(["tenant", "cell"]).indices.items():
                places = cells.get(key)
                if places is not None:
                    x = np.stack(batch["vec"].to_numpy()[rows])
                    best.add(np.round(x @ queries[places].T, SCORE_DIGITS), None, batch["ident"].to_numpy()[rows], places)
        yield pd.DataFrame({"place": best.query, "item_id": best.ident, "score": best.score})

    tenants, cells = sorted({t for t, _ in wanted}), sorted({c for _, c in wanted})
    rows = store.where(F.col("tenant").isin(tenants))
    if len(cells) <= MAX_NAMED_CELLS:
        rows = rows.where(F.col("cell").isin(cells))
    return rows.mapInPandas(score, f"place bigint, item_id {dict(store.dtypes)['ident']}, score double")


def _by_cell(asked: dict[str, _Asked], marks: dict[str, np.ndarray]) -> tuple[dict[tuple[str, int], np.ndarray], int]:
    wanted, pairs = {}, 0
    for name, own in asked.items():
        for at in np.flatnonzero(marks[name].any(axis=0)):
            places = own.places[marks[name][:, at]]
            wanted[name, int(own.cells[at])] = places
            pairs += len(places) * int(own.sizes[at])
    return wanted, pairs


def search_cells(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = CANDIDATES,
    tenant: str | None = None,
    query_id: str = "query_id",
    embedding: str = "embedding",
    max_queries: int = MAX_BROADCAST_QUERIES,
) -> Search:
    """The k best vectors of its own tenant for every query, from the store under ``path``; ties go to the smaller id.

    Queries without vector or tenant find nothing. Up to ``max_queries`` are searched at once.
    """
    asked = queries.select(
        F.col(query_id).alias("query_id"), F.col(embedding).cast("array<double>").alias("vec"), _folder(tenant).alias("tenant")
    ).where("vec IS NOT NULL AND tenant IS NOT NULL")
    store = stored_vectors(spark, path)
    kinds = dict(asked.dtypes) | dict(store.dtypes)
    n_queries = asked.count()
    # parts by hash differ in size, so they hold half of the most on average
    parts = 1 if n_queries <= max_queries else -(-2 * n_queries // max_queries)
    found, scored, whole = [], 0, 0
    for part in range(parts):
        head = asked.where(F.pmod(F.xxhash64("query_id", "vec"), F.lit(parts)) == part).toPandas()
        if head.empty:
            continue
        matrix = np.stack(head["vec"].to_numpy())
        by_tenant = _asked(spark, path, matrix, head["tenant"].to_numpy())
        if not by_tenant:
            continue
        near, _ = _by_cell(by_tenant, {name: own.nearest(k) for name, own in by_tenant.items()})
        first = _scan(store, matrix, near, k)
        ranked = first_per_group(first, ["place"], [F.desc("score"), F.col("item_id")], k, rank="rank")
        floors = np.full(len(matrix), -np.inf)
        for row in ranked.where(F.col("rank") == k).select("place", "score").collect():  # one row per query
            floors[row.place] = row.score
        marks = {name: own.bounds >= floors[own.places][:, None] for name, own in by_tenant.items()}
        wanted, pairs = _by_cell(by_tenant, marks)
        local = _scan(store, matrix, wanted, k)
        ids = spark.createDataFrame([(i, q) for i, q in enumerate(head["query_id"].tolist())], f"place bigint, query_id {kinds['query_id']}")
        best = first_per_group(local, ["place"], [F.desc("score"), F.col("item_id")], k, rank="rank")
        found.append(best.join(F.broadcast(ids), "place").select("query_id", "item_id", "score", "rank"))
        scored += pairs
        whole += sum(len(own.places) * int(own.sizes.sum()) for own in by_tenant.values())
    if not found:
        nothing = f"query_id {kinds['query_id']}, item_id {kinds['ident']}, score double, rank int"
        return Search(spark.createDataFrame([], nothing), 0, 0)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return Search(result, scored, whole)
