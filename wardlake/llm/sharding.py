"""Byte-balanced shards by Karmarkar-Karp differencing; documents with equal texts stay together.

Differencing keeps partial partitions (one sum per shard, sorted) in a heap and repeatedly combines the two of largest
spread, the largest sum of one with the smallest of the other, until one partition is left.

It runs in two levels so that no task sees all groups. Groups that are large by bytes or rows, at most
``2 * n_shards * HEAVY_PARTS`` of them, are differenced first. All others are dealt by hash into parts of about
``PART_GROUPS`` groups, and every part is differenced in its own task together with its share of the large groups'
loads as one more partial partition, pinned to its shards. So small groups fill what the large ones leave open, each
part ends within a few bytes, and the parts need no second round.

Rows of large groups get their shard from a broadcast of that bounded list; the others by a join on groups that hold
too few rows to skew it. Slots are numbered in two levels inside each shard.

Defined results: a null text counts 8 bytes and forms one group, apart from empty texts; repeated rows each get a
slot; rows without doc_id are placed like others; an empty table gives no rows; a group larger than a shard's share
fills its shard alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.scale import row_numbers
from wardlake.session import materialize

N_SHARDS = 24
# A group over 1 / (n_shards * HEAVY_PARTS) of all bytes or rows is placed in the first level.
HEAVY_PARTS = 1000
# Groups that one task of the second level differences.
PART_GROUPS = 4096
# Rows numbered in one task.
SLOT_ROWS = 50_000

GROUP = ["g1", "g2"]


def differencing(sizes: Sequence[int], k: int, loads: Sequence[int] | None = None) -> np.ndarray:
    """Shard 0..k-1 of every size; ``loads`` are what the shards hold before."""
    n = len(sizes)
    labels = np.zeros(n, dtype=np.int32)
    if not n:
        return labels
    sums: list[np.ndarray | None] = []
    for size in sizes:
        one = np.zeros(k, dtype=np.int64)
        one[0] = size
        sums.append(one)
    pinned = None
    if loads is not None:
        held = np.asarray(loads, dtype=np.int64)
        pinned = np.argsort(-held, kind="stable")
        sums.append(held[pinned] - held.min())
    leaves = len(sums)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both[0]), leaves + len(merges)))
        merges.append((a, b, order))
        sums.append(both)
    # from the last partition back to the sizes: which place of each partial partition became which shard
    places: list[np.ndarray | None] = [None] * len(sums)
    places[-1] = np.arange(k)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        shard, places[leaves + at] = places[leaves + at], None
        places[a] = np.empty(k, dtype=np.int64)
        places[b] = np.empty(k, dtype=np.int64)
        places[a][order] = shard
        places[b][k - 1 - order] = shard
    for i in range(n):
        labels[i] = places[i][0]
    if pinned is not None:
        rename = np.empty(k, dtype=np.int32)
        rename[places[n]] = pinned
        labels = rename[labels]
    return labels


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def byte_shards(docs: DataFrame, n_shards: int = N_SHARDS, part_groups: int = PART_GROUPS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text, text.isNull()).alias("g1"),
            F.xxhash64(F.lit("second"), text).alias("g2"),
        ),
        "shard-rows",
    )
    groups = materialize(_groups(rows), "shard-groups")
    total, n_rows, n_groups = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first())
    share = n_shards * HEAVY_PARTS
    is_heavy = (F.col("bytes") * share >= total) | (F.col("n") * share >= n_rows)
    heavy = groups.where(is_heavy).orderBy(F.desc("bytes"), *GROUP).collect()
    shards = differencing([r.bytes for r in heavy], n_shards)
    loads = np.zeros(n_shards, dtype=np.int64)
    np.add.at(loads, shards, [r.bytes for r in heavy])
    placed = [(r.g1, r.g2, int(s)) for r, s in zip(heavy, shards)]
    heavy_shards = spark.createDataFrame(placed, "g1 bigint, g2 bigint, shard int")

    rest = max(1, int(total) - int(loads.sum()))
    parts = max(1, -(-(int(n_groups) - len(heavy)) // part_groups))

    def difference(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", *GROUP], ascending=[False, True, True])
        own = int(part["bytes"].sum())
        held = [int(x) * own // rest for x in loads]
        found = differencing(part["bytes"].tolist(), n_shards, held)
        return pd.DataFrame({"g1": part["g1"], "g2": part["g2"], "shard": found})

    part = F.pmod(F.xxhash64(*GROUP), F.lit(parts)).alias("part")
    light = groups.where(~is_heavy).select(*GROUP, "bytes", part)
    light_shards = light.groupBy("part").applyInPandas(difference, "g1 bigint, g2 bigint, shard int")

    marked = rows.join(F.broadcast(heavy_shards), GROUP, "left")
    of_heavy = marked.where("shard IS NOT NULL")
    of_light = marked.where("shard IS NULL").drop("shard").join(light_shards, GROUP)
    dealt = materialize(of_heavy.unionByName(of_light).select("doc_id", "size", "text_crc32", *GROUP, "shard"), "shard-dealt")
    buckets = max(1, int(n_rows) // (n_shards * SLOT_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    order = [F.col(c) for c in ("doc_id", "text_crc32", *GROUP)]
    return row_numbers(dealt, ["shard"], bucket, order, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
