"""Near-duplicates by a MinHash forest: several sorted signature orders with longest-common-prefix neighbours.

A document is the set of its distinct word shingles. Documents with equal sets are one node. A node's signature has
``TREES * LEAD`` minima; tree t orders all nodes by the signature read from place ``t * LEAD`` on, and a region of the
tree is what shares its first ``LEAD`` minima there. Most nodes are alone in all their regions and drop out at once.

*Neighbours.* Within its region every node is compared with the ``NEIGHBOURS`` nodes that follow in the order, which
share the longest prefixes with it: in dense regions that is deep, in sparse ones it is ``LEAD``. Pairs whose
signatures agree on ``SURE_AGREEMENT`` are confirmed on the full sets, and the links give a first set of components.

*Rest.* A region that still holds several components has pairs the neighbours did not reach. There all nodes outside
its largest component are held against all nodes of the region, in blocks of bounded size, only across components and
only in the first tree that two nodes share. A pass over the signatures finds the nodes that agree with any other on
``MIN_AGREEMENT``; these meet again in blocks with their texts, and every such pair is settled on the full sets, unless
links of the block already connect it. What leaves a block is one link per pair of components, never all pairs. So
every two nodes that share a region are compared or connected; nothing is capped.

Two nodes of similarity 0.8 share no region with probability (1 - 0.8 ** LEAD) ** TREES = 3e-5, and their signatures
fall under ``MIN_AGREEMENT`` with probability 2e-4; both fall off fast above 0.8. Everything found is exact.

Sets hold 64-bit hashes of shingles; sets are told apart by 128 bits.

Defined results: documents without words have no shingles and are linked with nothing; rows of one doc_id are one
document, linked with whatever any of them resembles; rows without doc_id are linked with nothing and have a null
component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.joins import HOT_SHARE, components, hot_join, rows_with_ids
from wardlake.llm.words import NOT_SPACE, Words, arrow_rows, chunks, mix, release_memory, window_hashes
from wardlake.session import materialize

TREES, LEAD = 20, 4
PLACES = TREES * LEAD
NEIGHBOURS = 3
SIMILARITY = Fraction(8, 10)
# Share of equal minima that a pair needs before its full sets are compared, in the second and in the first pass.
MIN_AGREEMENT, SURE_AGREEMENT = 0.64, 0.78
# Nodes on either side of one block comparison, and how many a block may hold to go through the plain array pass.
BLOCK_NODES, SMALL_BLOCK = 512, 12

_FACTORS = (mix(np.arange(1, PLACES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (mix(np.arange(1001, 1001 + PLACES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SHINGLE_ROWS = 4096


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], NOT_SPACE)
        windows = window_hashes(words.hashes, k)
        for first, last in zip(words.first[:-1], words.first[1:]):
            n = last - first
            if n >= k:
                yield np.unique(windows[first : last - k + 1])
            else:
                yield window_hashes(words.hashes[first:last], n) if n else windows[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """Signature of a set: per place 16 bits of its smallest hash."""
    base = (mix(shingles) >> np.uint64(32)).astype(np.uint32)[:, None]
    least = None
    for at in range(0, len(base), _SHINGLE_ROWS):
        part = (base[at : at + _SHINGLE_ROWS] * _FACTORS + _OFFSETS).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def nodes_of(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set1, set2 (identity of the set), regions (one key per tree), signature."""
    fields = [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set1", pa.int64()),
        ("set2", pa.int64()),
        ("regions", pa.list_(pa.int64())),
        ("signature", pa.binary()),
    ]
    ddl = "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, regions array<bigint>, signature binary"

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name, _ in fields}
            for doc, own in zip(batch["doc_id"], shingle_sets(batch["text"], k)):
                if len(own):
                    mixed = mix(own)
                    least = minima(own)
                    identity = mixed.sum().view(np.int64), mix(mixed).sum().view(np.int64)
                    row = *map(int, identity), least.view(np.int64).tolist(), least.tobytes()
                else:
                    row = None, None, None, None
                for column, value in zip(out.values(), (doc, len(own), *row)):
                    column.append(value)
            yield out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_rows(rows, run, pa.schema(fields), ddl)


def _signatures(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(-1, PLACES)


def _neighbours(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes next to each other in a tree's order that agree on most places.

    The order is cut into ranges anywhere, also inside a region; pairs over a cut are left to the second pass.
    """
    turn = F.expr(f"tree * {2 * LEAD}")
    order = F.concat(F.substring("signature", turn + 1, 2 * PLACES), F.substring("signature", F.lit(1), turn))
    keyed = members.select("tree", "region", order.alias("place"), "node")
    dealt = keyed.repartitionByRange("tree", "region", "place", "node").sortWithinPartitions("tree", "region", "place", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            now = tuple(np.array(batch.column(c)) for c in ("tree", "region", "node"))
            signs = _signatures(batch.column("place").to_pylist())
            tree, region, node, signs = (np.concatenate(p) for p in zip(tail, (*now, signs))) if tail else (*now, signs)
            lefts, rights = [], []
            for step in range(1, NEIGHBOURS + 1):
                same = (tree[step:] == tree[:-step]) & (region[step:] == region[:-step])
                same[same] = (signs[:-step][same] == signs[step:][same]).mean(axis=1) >= SURE_AGREEMENT
                lefts.append(np.minimum(node[:-step][same], node[step:][same]))
                rights.append(np.maximum(node[:-step][same], node[step:][same]))
            tail = tuple(x[-NEIGHBOURS:] for x in (tree, region, node, signs))
            a, b = np.concatenate(lefts), np.concatenate(rights)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


REGION = ["tree", "region"]
BLOCK = [*REGION, "left", "right"]


def _in_blocks(known: DataFrame) -> DataFrame:
    """Rows of the regions with several components, dealt into blocks (tree, region, left, right).

    ``asks`` marks the nodes outside the region's largest component. A region of few nodes is one block with every row
    once; in a larger one each block holds a part of the asking nodes and a part of all nodes.
    """
    sizes = known.groupBy(*REGION, "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(*REGION).agg(
        F.sum("n").alias("n"), F.max("n").alias("largest"), F.max_by("component", F.struct("n", "component")).alias("main")
    ).where("largest < n")
    lefts = F.ceil((F.col("n") - F.col("largest")) / BLOCK_NODES).cast("int").alias("lefts")
    rights = F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("rights")
    rows = known.join(mixed.select(*REGION, "main", lefts, rights), REGION)
    asks, at = F.col("component") != F.col("main"), F.xxhash64("node")

    def place(left: Column, right: Column, asking: Column) -> Column:
        return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), asking.alias("asks"))

    once = F.array(place(F.lit(0), F.lit(0), asks))
    own_left, own_right = F.pmod(at, "lefts"), F.pmod(at, "rights")
    asking = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda r: place(own_left, r, F.lit(True)))
    asked = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda x: place(x, own_right, F.lit(False)))
    places = F.when(F.col("rights") == 1, once).when(asks, F.concat(asking, asked)).otherwise(asked)
    return rows.select(*REGION, F.inline(places), "node", "component", "signature")


def _blocks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Whole blocks of rows sorted by block: arrays of tree, block number, asks, node, component, signatures, and
    ``more`` columns as lists. The last block of a batch waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        keys = [held.column(c).to_numpy() for c in BLOCK]
        opens = np.ones(held.num_rows, dtype=bool)
        if held.num_rows:
            opens[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            last = int(np.flatnonzero(opens)[-1])
            if last:
                yield _arrays(held.slice(0, last), opens[:last], more)
                held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        opens = np.zeros(held.num_rows, dtype=bool)
        opens[0] = True
        yield _arrays(held, opens, more)


def _arrays(rows: pa.Table, opens: np.ndarray, more: tuple[str, ...]) -> tuple:
    tree, node, component = (rows.column(c).to_numpy() for c in ("tree", "node", "component"))
    asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    signs = _signatures(rows.column("signature").to_pylist())
    return tree, np.cumsum(opens) - 1, asks, node, component, signs, *(rows.column(c).to_pylist() for c in more)


def _candidates(tree, block, asks, component, signs) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside blocks that agree well enough, cross components, and share no earlier tree."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        wanted = (component[i] != component[j]) & (asks[i] | asks[j])
        i, j = i[wanted], j[wanted]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            same = signs[x] == signs[y]
            good = same.mean(axis=1, dtype=np.float32) >= MIN_AGREEMENT
            x, y, same = x[good], y[good], same[good]
            first = same.reshape(-1, TREES, LEAD).all(axis=2).argmax(axis=1) == tree[x]
            found.append((x[first], y[first]))

    sizes = np.bincount(block)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    small = np.flatnonzero(sizes[block] <= SMALL_BLOCK)
    for step in range(1, SMALL_BLOCK):
        i = small[small + step < len(block)]
        i = i[block[i] == block[i + step]]
        keep(i, i + step)
    for b in np.flatnonzero(sizes > SMALL_BLOCK):
        rows = np.arange(starts[b], starts[b] + sizes[b])
        for i in rows[asks[rows]]:
            keep(np.full(sizes[b], i), rows)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    return np.minimum(i, j), np.maximum(i, j)


def _promising(dealt: DataFrame) -> DataFrame:
    """(tree, region, node) of the nodes that agree with any other of their block."""
    schema = pa.schema([("tree", pa.int32()), ("region", pa.int64()), ("node", pa.int64())])
    rows = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, asks, node, component, signs, region in _blocks(batches, "region"):
            at = np.unique(np.concatenate(_candidates(tree, block, asks, component, signs)))
            columns = tree[at], np.array(region, dtype=np.int64)[at], node[at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "tree int, region bigint, node bigint").distinct()


def _settled(dealt: DataFrame, k: int) -> DataFrame:
    """Links (a, b) between components of a block, confirmed on full sets; takes blocks with ``text``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, asks, node, component, signs, texts in _blocks(batches, "text"):
            left, right = _candidates(tree, block, asks, component, signs)
            needed = np.unique(np.concatenate([left, right]))
            raw = [None if texts[i] is None else texts[i].encode() for i in needed]
            sets = dict(zip(needed.tolist(), shingle_sets(raw, k)))
            order = np.argsort(-(signs[left] == signs[right]).sum(axis=1), kind="stable")
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while c in joined:
                    c = joined[c]
                return c

            a, b = [], []
            for i, j in zip(left[order].tolist(), right[order].tolist()):
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y and similar(sets[i], sets[j]):
                    joined[max(x, y)] = min(x, y)
                    a.append(int(node[i]))
                    b.append(int(node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
        release_memory()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _rest_links(members: DataFrame, labels: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Links between components that share a region and were not compared as neighbours."""
    own = F.coalesce("component", "node").alias("component")
    known = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select(*REGION, "node", own, "signature")
    known = materialize(known, "forest-known")
    promising = materialize(_promising(_in_blocks(known)), "forest-promising")
    again = known.join(promising, [*REGION, "node"], "left_semi")
    texts = _texts(docs, promising.select(F.col("node").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node")
    return _settled(_in_blocks(again).join(texts, "node"), k)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes, each sorted, have at least ``SIMILARITY``."""
    least, most = sorted((len(x), len(y)))
    if least < SIMILARITY * most:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int((x[at] == y).sum())
    return common > 0 and common >= SIMILARITY * (len(x) + len(y) - common)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(rows_with_ids(own, ids, "doc_id"), "forest-texts")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b) those whose full sets are similar enough."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            a, b = [], []
            both = zip(shingle_sets(batch["text_a"], k), shingle_sets(batch["text_b"], k))
            for left, right, (x, y) in zip(batch["a"], batch["b"], both):
                if len(x) and similar(x, y):
                    a.append(left)
                    b.append(right)
            yield {"a": a, "b": b}

    return arrow_rows(rows, run, schema, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id it is linked with, over any number of steps), kept."""
    rows = materialize(nodes_of(docs, k), "forest-rows")
    linked = rows.where("set1 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = linked.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("n"), F.max("signature").alias("signature"), F.max("regions").alias("regions")
    )
    nodes = materialize(nodes, "forest-nodes")
    forest = nodes.select("node", F.posexplode("regions").alias("tree", "region"))
    shared = forest.groupBy("tree", "region").agg(F.count("*").alias("n")).where("n > 1").select("tree", "region")
    members = forest.join(shared, ["tree", "region"]).join(nodes.select("node", "signature"), "node")
    members = materialize(members.select("tree", "region", "node", "signature"), "forest-members")

    near = materialize(_neighbours(members), "forest-near")
    links = confirmed(near, docs, k)
    # one document with several sets ties its nodes together
    several = linked.groupBy("doc_id").agg(F.min("set1").alias("s"), F.max("set1").alias("t")).where("s < t").select("doc_id")
    tied = linked.join(several, "doc_id", "left_semi").join(nodes.select("set1", "set2", "node"), ["set1", "set2"])
    links = links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    links = materialize(links, "forest-links")
    labels = components(links)

    more = materialize(_rest_links(members, labels, docs, k), "forest-more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    found = nodes.join(labels.withColumnRenamed("id", "node"), "node", "left")
    by_set = found.select("set1", "set2", "n", F.coalesce("component", "node").alias("component_id"))
    total = linked.count()
    out = hot_join(rows.select("doc_id", "n_shingles", "set1", "set2"), by_set, ["set1", "set2"], F.col("n") * HOT_SHARE >= total, ["component_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def clean_documents(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with the smallest doc_id of every group of near-duplicates only."""
    gone = "__gone" + "_" * max(map(len, docs.columns))  # longer than any column, so a name of its own
    dropped = near_duplicates(docs, k).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")
