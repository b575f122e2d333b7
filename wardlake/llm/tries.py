"""Prefix trie of conversations with subtree totals by parallel tree contraction (``contraction``).

A node of depth d is a distinct sequence of first d turns. Turns are numbered inside their conversation by a range sort
with prefix counts, so one conversation may hold a third of all rows. A prefix is known by two exclusive-ors of 64-bit
hashes of (place, turn): these are running sums that need no walk along the conversation and finish in two levels.
Texts are read once, for their words and their digest; only digests are shuffled.

Nodes come from one grouping of the prefixes, pre-aggregated before the shuffle, so a first turn that many
conversations share is a few rows per task. Children find their parent by a join that broadcasts the parents of many
children, at most ``HOT_SHARE`` rows.

The ids of the conversations that end at a node are range-sorted by (node, id) and joined into short strings, which one
task per node streams through SHA-256 in order, holding one batch: a digest of a sequence can't be put together from
parts, but no list of ids is ever whole in memory.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; equal turn numbers
are ordered by role and then by the digest of the text, equal rows are separate turns; a conversation without turns
after the exchange of heads ends at the root; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.contraction import subtree_sums
from wardlake.llm.joins import HOT_SHARE, hot_join
from wardlake.llm.mixing import WORD, n_words
from wardlake.scale import running, sorted_running
from wardlake.session import materialize

# Conversations whose ids share this multiple take their first turns from it.
HEAD_EVERY = 20
# Fewer turns than this are taken.
HEAD_TURNS = 4
# Turns of one conversation that one task walks along.
RUN_TURNS = 4096
# Ids joined into one string before hashing.
ID_STRING = 256

NODE = ["depth", "k1", "k2"]
TURNS = "conv_id bigint, pos bigint, turn_key string, words bigint"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_key, words) of every turn with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"),
        n_words(text).alias("words"),
        F.monotonically_increasing_id().alias("__row"),
    )
    order = [F.col(c) for c in ("turn", "role", "turn_key", "__row")]
    placed = sorted_running(turns, ["conv_id"], order, {"pos": F.lit(1).cast("bigint")}, "trie-turns")
    return materialize(placed.select("conv_id", "pos", "turn_key", "words"), "trie-numbered")


def sizes(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns)."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def _head_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEAD_TURNS))


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes after every conversation c took its first h turns from c - c % HEAD_EVERY, h from a hash of c."""
    own = sizes(turns).withColumn("h", _head_turns(F.col("conv_id")))
    giver = F.col("conv_id") - F.col("conv_id") % F.lit(HEAD_EVERY)
    givers = own.select(F.col("conv_id").alias("__giver"), F.col("n_turns").alias("__n"))
    taken = F.least(F.col("h"), F.coalesce("__n", F.lit(0)))
    convs = materialize(
        own.withColumn("__of", giver)
        .join(givers, F.col("__of") == F.col("__giver"), "left")
        .select("conv_id", "__of", "h", taken.alias("__taken"), F.col("n_turns").alias("__own")),
        "trie-heads",
    )
    heads = turns.where((F.col("pos") < HEAD_TURNS) & (F.col("conv_id") % F.lit(HEAD_EVERY) == 0))
    heads = heads.select(F.col("conv_id").alias("__from"), "pos", "turn_key", "words")
    given = convs.join(heads, (F.col("__of") == F.col("__from")) & (F.col("pos") <= F.col("h")))
    total = convs.agg(F.coalesce(F.sum("__own"), F.lit(0))).first()[0]
    tails = hot_join(turns, convs, ["conv_id"], F.col("__own") * HOT_SHARE >= F.lit(total), ["h", "__taken"])
    tails = tails.where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("__taken"))
    columns = ["conv_id", "pos", "turn_key", "words"]
    rebuilt = given.select(*columns).unionByName(tails.select(*columns))
    n_turns = F.col("__taken") + F.greatest(F.col("__own") - F.col("h"), F.lit(0))
    return rebuilt, convs.select("conv_id", n_turns.cast("bigint").alias("n_turns"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): every conversation's prefixes from depth 1 on, p1 and p2 one turn before."""
    marks = [F.xxhash64(F.lit(seed), "pos", "turn_key") for seed in ("first", "second")]
    marked = turns.withColumns({"x1": marks[0], "x2": marks[1]})
    bucket = F.floor(F.col("pos") / RUN_TURNS)
    keyed = running(marked, ["conv_id"], bucket, [F.col("pos")], {}, xors={"k1": F.col("x1"), "k2": F.col("x2")})
    return keyed.select(
        "conv_id", F.col("pos").alias("depth"), "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words",
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from rows sorted by (node, place)."""
    at, digest, found = None, None, []

    def emitted() -> pa.RecordBatch:
        columns = zip(*found) if found else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            [*NODE, "ends_sha256"],
        )

    for batch in batches:
        keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in NODE])
        for key, ids in zip(keys, batch.column(batch.schema.get_field_index("ids")).to_pylist()):
            if key != at:
                if at is not None:
                    found.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield emitted()
        found = []
    if at is not None:
        found.append((*at, digest.hexdigest()))
    yield emitted()


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id)."""
    part = F.spark_partition_id()
    laid = materialize(ends.repartitionByRange(*NODE, "conv_id").withColumn("__part", part), "trie-ends")
    runs = laid.groupBy(*NODE, "__part").agg(F.array_sort(F.collect_list("conv_id")).alias("run"))
    starts = F.sequence(F.lit(1), F.size("run"), F.lit(ID_STRING))
    strings = F.transform(starts, lambda at: F.array_join(F.slice("run", at, F.lit(ID_STRING)), ","))
    pieces = runs.select(*NODE, "__part", F.posexplode(strings).alias("__at", "ids"))
    sorted_pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "__part", "__at")
    schema = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    return sorted_pieces.select(*NODE, "ids").mapInArrow(_hashed, schema)


def _nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes with a number, their parent's number and conv_id, and what is known without looking below."""
    zero = F.lit(0).cast("bigint")
    prefixes = materialize(_prefixes(turns), "trie-prefixes")
    grouped = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        *[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("words"),
        F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
    )
    last = [F.col("conv_id").alias("__conv"), F.col("n_turns").alias("__last")]
    met = (F.col("conv_id") == F.col("__conv")) & (F.col("depth") == F.col("__last"))
    ends = prefixes.join(lengths.select(*last), met, "left_semi").select(*NODE, "conv_id")
    ends = ends.unionByName(lengths.where("n_turns = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    families = grouped.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    nodes = grouped.unionByName(root).join(families, NODE, "left").join(_end_digests(ends), NODE, "left")
    nodes = materialize(
        nodes.select(
            F.monotonically_increasing_id().alias("id"), *NODE, "conv_id", "n_convs", "words", "p1", "p2",
            F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    parents = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    hot = F.col("n_children") * HOT_SHARE >= F.lit(nodes.count())
    return materialize(hot_join(nodes, parents, ["p1", "p2", "depth"], hot, ["parent", "parent_conv_id"]), "trie-tree")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (as ``numbered`` gives them) and ``lengths`` (conv_id, n_turns):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tree = _nodes(turns, lengths)
    held = tree.select(
        "id",
        "parent",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = subtree_sums(held, ["n_leaves", "saved_tokens"])
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    return tree.select("id", *kept, "ends_sha256").join(sums, "id").select(*kept, "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = numbered(conversations)
    return trie(turns, sizes(turns))


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """The trie after the exchange of heads."""
    return trie(*with_shared_heads(numbered(conversations)))


TRIE_SQL = rf"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id
                              ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, count(*) AS n,
           xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                                                  lambda c: [ascii(c)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT])),
                           lambda crc, b: xor(xor(crc, b) // 2, CASE WHEN xor(crc, b) % 2 = 1 THEN 3988292384 ELSE 0 END),
                           4294967295::BIGINT), 4294967295) % {HEAD_TURNS} AS h
    FROM own GROUP BY conv_id
), convs AS (
    SELECT ids.conv_id, ids.n, ids.h, ids.conv_id - ids.conv_id % {HEAD_EVERY} AS giver, least(ids.h, coalesce(g.n, 0)) AS taken
    FROM ids LEFT JOIN ids g ON g.conv_id = ids.conv_id - ids.conv_id % {HEAD_EVERY}
), rebuilt AS (
    SELECT convs.conv_id, own.pos AS d, role, text FROM convs JOIN own ON own.conv_id = convs.giver AND own.pos <= convs.h
    UNION ALL
    SELECT own.conv_id, own.pos - h + taken, role, text FROM own JOIN convs USING (conv_id) WHERE own.pos > h
), prefixes AS (
    SELECT conv_id, d, text,
           string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d)
               OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path,
           d = count(*) OVER (PARTITION BY conv_id) AS is_end
    FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, '', '', taken + greatest(n - h, 0) = 0 FROM convs
), nodes AS (
    SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           len(regexp_extract_all(any_value(text), '{WORD}')) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
    FROM prefixes GROUP BY path
), tree AS (
    SELECT nodes.*, up.conv_id AS parent_conv_id
    FROM nodes LEFT JOIN nodes up ON nodes.depth > 0 AND up.path = left(nodes.path, 32 * (nodes.depth - 1)::INT)
), families AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL
), above AS (
    SELECT p.path, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children IS NULL) AS n_leaves
    FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN families f ON f.conv_id = n.conv_id AND f.depth = n.depth
    GROUP BY p.path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM tree JOIN above USING (path) LEFT JOIN families USING (conv_id, depth)
"""
