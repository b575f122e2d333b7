"""Embedding, exact top-k search, re-ranking and context assembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.scalars import strip
from wardlake.operators.selection import first_per_group

EMBED_DIM = 384
CANDIDATES = 20
KEPT = 5
CONTEXT_CHARS = 1_500
# Queries that may be broadcast to every task; larger sets go through the block join.
MAX_BROADCAST_QUERIES = 4_096
SCORE_DIGITS = 9
# What stands between words, in any alphabet.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"
BM25_K1 = 1.2
BM25_B = 0.75
# Rows multiplied at once.
SLAB = 1_024


# --- embedding -----------------------------------------------------------------------------------


def fit_encoder(chunks: DataFrame, text: str = "text", dim: int = EMBED_DIM) -> PipelineModel:
    """Hashed term weights as unit vectors. The fitted state is ``dim`` numbers."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=WORD_BREAK, toLowercase=True),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dim),
            IDF(inputCol="__tf", outputCol="__idf"),
            Normalizer(inputCol="__idf", outputCol="__unit"),
        ]
    ).fit(chunks)


def embed(df: DataFrame, encoder: PipelineModel, into: str = "embedding") -> DataFrame:
    coded = encoder.transform(df).withColumn(into, vector_to_array("__unit", "float32"))
    return coded.drop("__tokens", "__tf", "__idf", "__unit")


def embed_with(df: DataFrame, encode: Column, into: str = "embedding") -> DataFrame:
    """Any other encoder: ``encode`` is a (pandas UDF) column giving an array of floats."""
    return df.withColumn(into, encode)


# --- exact top-k ---------------------------------------------------------------------------------


class BestRows:
    """Best k rows per query seen so far in one task."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ident = np.empty(0, dtype=object)
        self.floor = np.full(n_queries, -np.inf)

    def add(
        self, scores: np.ndarray, allowed: np.ndarray | None, idents: np.ndarray, places: np.ndarray | None = None
    ) -> None:
        """Scores of rows (down) against queries (across): all of them, or those at ``places``."""
        good = scores >= (self.floor if places is None else self.floor[places])[None, :]
        if allowed is not None:
            good &= allowed
        rows, columns = np.nonzero(good)
        queries = columns if places is None else places[columns]
        self.query = np.concatenate([self.query, queries])
        self.score = np.concatenate([self.score, scores[rows, columns]])
        self.ident = np.concatenate([self.ident, idents[rows]])
        # ties are broken by id, so everything equal to the k-th score stays in until here
        order = np.lexsort((self.ident, -self.score, self.query))
        query = self.query[order]
        starts = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - starts
        keep = order[place < self.k]
        self.floor[query[place == self.k - 1]] = self.score[order[place == self.k - 1]]
        self.query, self.score, self.ident = self.query[keep], self.score[keep], self.ident[keep]


def _search(batch: pd.DataFrame, matrix: np.ndarray, tenants: np.ndarray | None, best: BestRows) -> None:
    for at in range(0, len(batch), SLAB):
        slab = batch.iloc[at : at + SLAB]
        vectors = np.stack(slab["vec"].to_numpy()).astype(np.float64)
        allowed = None if tenants is None else slab["tenant"].to_numpy()[:, None] == tenants[None, :]
        best.add(np.round(vectors @ matrix.T, SCORE_DIGITS), allowed, slab["ident"].to_numpy())


def _found(best: BestRows, query_ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_ids[best.query], "item_id": best.ident, "score": best.score})


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATES,
    vector_id: str = "chunk_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    tenant: str | None = None,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Exact inner-product top-k per query: ``(query_id, item_id, score, rank)``; ties go to the smaller id.

    With few queries their matrix is sent to every task and the vectors are read once, without a
    shuffle; each task passes on at most k rows per query. With more queries than ``max_broadcast``
    both sides are cut into blocks and each pair of blocks is searched by one task.
    """
    items = vectors.select(F.col(vector_id).alias("ident"), F.col(embedding).alias("vec"), *_tenant(tenant)).where(
        F.col("vec").isNotNull()
    )
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("qvec"), *_tenant(tenant)).where(
        F.col("qvec").isNotNull()
    )
    if tenant:  # without a tenant there is nothing a query may see
        items, asked = items.where("tenant IS NOT NULL"), asked.where("tenant IS NOT NULL")
    kinds = dict(items.dtypes) | dict(asked.dtypes)
    schema = f"query_id {kinds['query_id']}, item_id {kinds['ident']}, score double"
    head = asked.limit(max_broadcast + 1).toPandas()  # bounded by the limit
    if len(head) <= max_broadcast:
        local = _broadcast_search(items, head, k, tenant is not None, schema)
    else:
        local = _block_search(items, asked, k, tenant is not None, schema, max_broadcast)
    return first_per_group(local, ["query_id"], [F.desc("score"), F.col("item_id")], k, rank="rank")


def _tenant(tenant: str | None) -> list[Column]:
    return [F.col(tenant).alias("tenant")] if tenant else []


def _broadcast_search(items: DataFrame, head: pd.DataFrame, k: int, by_tenant: bool, schema: str) -> DataFrame:
    if head.empty:
        return items.sparkSession.createDataFrame([], schema)
    shared = items.sparkSession.sparkContext.broadcast(
        (
            np.stack(head["qvec"].to_numpy()).astype(np.float64),
            head["query_id"].to_numpy(),
            head["tenant"].to_numpy() if by_tenant else None,
        )
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, ids, tenants = shared.value
        best = BestRows(len(ids), k)
        for batch in batches:
            _search(batch, matrix, tenants, best)
        yield _found(best, ids)

    return items.mapInPandas(scan, schema)


def _block_search(
    items: DataFrame, asked: DataFrame, k: int, by_tenant: bool, schema: str, block: int
) -> DataFrame:
    """Grid of query blocks and vector blocks. A task holds one block of queries, past which its vectors stream."""
    query_blocks = max(1, math.ceil(2 * asked.count() / block))
    vector_blocks = max(1, math.ceil(items.count() / 200_000))

    def spread(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = items.select("*", F.pmod(F.xxhash64("ident"), F.lit(vector_blocks)).cast("int").alias("vb"), spread(query_blocks, "qb"))
    right = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"), spread(vector_blocks, "vb"))
    # the queries of a block come before its vectors
    both = right.withColumn("side", F.lit(0)).unionByName(left.withColumn("side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("qb", "vb").sortWithinPartitions("qb", "vb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, queries = None, None, []
        matrix = ids = tenants = None

        def out() -> pa.RecordBatch:
            found = _found(best, ids)
            kinds = [types["query_id"], types["ident"], pa.float64()]
            columns = [pa.array(found[c], type=t, from_pandas=True) for c, t in zip(found.columns, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=list(found.columns))

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("qb", "vb", "side")], axis=1)
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = [0, *starts.tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(bounds, bounds[1:]):
                own, part = tuple(keys[lo, :2].tolist()), batch.slice(lo, hi - lo)
                if own != block:
                    if best is not None:
                        yield out()
                    block, best, queries = own, None, []
                if keys[lo, 2] == 0:
                    queries.append(part.select([c for c in part.schema.names if c not in ("ident", "vec")]).to_pandas())
                elif queries:
                    if best is None:
                        head = pd.concat(queries)
                        matrix, ids = np.stack(head["qvec"].to_numpy()).astype(np.float64), head["query_id"].to_numpy()
                        tenants, best = head["tenant"].to_numpy() if by_tenant else None, BestRows(len(ids), k)
                    _search(part.select([c for c in part.schema.names if c not in ("query_id", "qvec")]).to_pandas(), matrix, tenants, best)
        if best is not None:
            yield out()

    return dealt.mapInArrow(run, schema)


# --- re-ranking ----------------------------------------------------------------------------------


def _terms(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), WORD_BREAK), lambda t: t != "")


def bm25_scores(pairs: DataFrame) -> DataFrame:
    """BM25 of each candidate against its query, with statistics from the query's own candidates.

    ``pairs`` has ``query_id, item_id, query_text, text``.
    """
    sized = pairs.select("query_id", "item_id", _terms("query_text").alias("q"), _terms("text").alias("t"))
    pool = sized.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    # only words of the query leave the row; counting them is a plain aggregation
    words = sized.select(
        "query_id", "item_id", F.size("t").alias("dl"),
        F.explode(F.filter("t", lambda w: F.array_contains("q", w))).alias("w"),
    )
    hits = words.groupBy("query_id", "item_id", "w").agg(F.first("dl").alias("dl"), F.count("*").alias("tf"))
    df = hits.groupBy("query_id", "w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    weight = (idf * F.col("tf") * (BM25_K1 + 1) / norm).cast("decimal(28,10)")
    scored = hits.join(df, ["query_id", "w"]).join(pool, "query_id").groupBy("query_id", "item_id").agg(
        F.sum(weight).cast("double").alias("rerank_score")
    )
    return (
        pairs.select("query_id", "item_id")
        .join(scored, ["query_id", "item_id"], "left")
        .select("query_id", "item_id", F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"))
    )


def rerank(
    candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = KEPT, scorer: Column | None = None
) -> DataFrame:
    """Score the candidates jointly with their query and keep k: ``(query_id, item_id, rerank_score, rank)``.

    ``queries`` has ``query_id, query_text``; ``chunks`` has ``item_id, text``. ``scorer`` may be a
    pandas UDF column over ``query_text`` and ``text`` instead of the default.
    """
    pairs = candidates.select("query_id", "item_id").join(queries, "query_id").join(chunks, "item_id")
    if scorer is None:
        scored = bm25_scores(pairs.select("query_id", "item_id", "query_text", "text"))
    else:
        scored = pairs.select("query_id", "item_id", scorer.alias("rerank_score"))
    return first_per_group(scored, ["query_id"], [F.desc("rerank_score"), F.col("item_id")], k, rank="rank")


# --- context -------------------------------------------------------------------------------------


def context_block(passages: DataFrame) -> DataFrame:
    """Numbered passages per query joined by blank lines. ``passages``: query_id, rank, citation, text (k rows each).

    A passage without text or citation keeps its number and head, with nothing in the place of what is missing.
    """
    body = F.concat(
        F.lit("["), F.col("rank"), F.lit("] (source: "), F.coalesce("citation", F.lit("")), F.lit(")\n"),
        F.coalesce(strip(F.left("text", F.lit(CONTEXT_CHARS))), F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"))))
    return passages.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.body), "\n\n").alias("context"))


def dedup_sources(passages: DataFrame) -> DataFrame:
    """First occurrence of each citation per query."""
    return passages.groupBy("query_id", "citation").agg(F.min("rank").alias("first_rank"))


def index_alignment(chunks: DataFrame, vectors: DataFrame, chunk_id: str, vector_id: str) -> DataFrame:
    """Chunks without a vector and vectors without a chunk."""
    left = chunks.select(F.col(chunk_id).alias("k"), F.lit(1).alias("c"))
    right = vectors.select(F.col(vector_id).alias("k"), F.lit(1).alias("v"))
    return left.join(right, "k", "full_outer").agg(
        F.count("c").alias("chunks"),
        F.count("v").alias("vectors"),
        F.count_if(F.col("v").isNull()).alias("without_vector"),
        F.count_if(F.col("c").isNull()).alias("without_chunk"),
    )
