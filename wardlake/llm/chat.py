"""Reply trees as training conversations: root-to-leaf paths by iterative self-joins, ranked branches, one template.

Every message points to the one it answers. Pointers are doubled by self-joins: after k rounds a message knows its
ancestor 2^k steps up, the sum of scores on the way and the distance, so a tree of depth d takes log2(d) rounds. Leaves
are then ranked inside their tree by the mean score of their path, and the paths of the chosen leaves are filled in by
walking the same jump tables from the longest to the shortest, which again doubles what is known in every round. Each
round is written to the shared folder.

A chosen path becomes one text: ``<|turn|>role<|text|>text<|end|>`` and a line end per turn. In roles and texts every
backslash is doubled and a backslash follows the first character of every control string, so that none occurs inside
them and the original comes back exactly. The loss mask lists the places of the assistant's texts.

Defined results: null roles and texts count as empty; a message whose parent is missing is a root; messages on a cycle
belong to no path; equal messages are separate turns; an empty table has no conversations. A conversation is one row of
the result, so it must fit in a task; how many there are, or how often one is copied, does not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.words import arrow_rows
from wardlake.session import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
# Control strings of this and other public chat templates; no two of them can overlap.
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>")

NODE = ["tree", "node"]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted text and its loss mask as flat (from, to) places in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == LEARNED_ROLE:
            mask += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns a formatted text was made of."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def masked_text(formatted: str, mask: list[int]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in zip(mask[0::2], mask[1::2]))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up) of 1, 2, 4, ... steps, and per node its path from the root: total score, depth."""
    present = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(present, ["tree", "parent"], "left")
    up = F.when(F.col("known"), F.col("parent"))
    state = materialize(
        linked.select(*NODE, up.alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth")), "chat-jump"
    )
    tables, left = [], None
    while True:
        open_now = state.where("up IS NOT NULL").count()
        # every round settles some node of each unsettled path, so what stays at the same number runs in circles
        if not open_now or open_now == left:
            return tables, state.where("up IS NULL")
        left = open_now
        tables.append(state.where("up IS NOT NULL").select(*NODE, "up"))
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        done = state.where("up IS NULL")
        further = state.where("up IS NOT NULL").join(far, ["tree", "up"])
        moved = further.select(*NODE, F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"))
        state = materialize(done.unionByName(moved), "chat-jump")


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the messages on each tree's best root-to-leaf paths; ``None`` takes all leaves.

    Takes tree, node, parent and score. Leaves are ranked by the mean score of their path, ties by the smaller node.
    """
    nodes = nodes.select(*NODE, "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tables, rooted = _jumps(nodes)
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, NODE, "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    if branches is not None:
        leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    found = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node"), "chat-paths")
    for table in reversed(tables):
        above = found.join(table, NODE).select("tree", "leaf", F.col("up").alias("node"))
        found = materialize(found.unionByName(above), "chat-paths")
    return found.join(rooted.select(*NODE, "depth"), NODE)


def conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, formatted, loss_mask) of the chosen paths; takes tree, node, parent, role, text and score."""
    said = nodes.select(*NODE, "role", "text")
    turns = paths(nodes, branches).join(said, NODE).select("tree", "leaf", "depth", "role", "text")
    dealt = turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
    schema = pa.schema(
        [("tree", pa.string()), ("leaf", pa.int64()), ("formatted", pa.string()), ("loss_mask", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        held, turns = None, []

        def row() -> tuple:
            return held[0], held[1], *format_turns(turns)

        for batch in batches:
            out = []
            for tree, leaf, role, text in zip(batch["tree"], batch["leaf"], batch["role"], batch["text"]):
                if held is not None and held != (tree, leaf):
                    out.append(row())
                    turns = []
                held = (tree, leaf)
                turns.append(((role or b"").decode(), (text or b"").decode()))
            if out:
                yield dict(zip(schema.names, map(list, zip(*out))))
        if held is not None:
            yield dict(zip(schema.names, ([v] for v in row())))

    return arrow_rows(dealt, run, schema, "tree string, leaf bigint, formatted string, loss_mask array<bigint>")


def as_trees(rows: DataFrame) -> DataFrame:
    """Turn-by-turn rows (conv_id, turn, role, text) as trees in which every turn answers the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(*NODE, parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Contract columns of every formatted conversation: what its text and mask say."""
    schema = pa.schema(
        [
            ("tree", pa.string()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )
    ddl = "tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for tree, raw, mask in zip(batch["tree"], batch["formatted"], batch["loss_mask"]):
                text = raw.decode()
                turns, learned = read_turns(text), masked_text(text, mask)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                loss = hashlib.sha256(learned.encode()).hexdigest()
                for column, value in zip(out.values(), (tree.decode(), len(turns), digest, len(learned), loss, len(text))):
                    column.append(value)
            yield out

    rows = arrow_rows(formatted.select("tree", "formatted", "loss_mask"), run, schema, ddl)
    conv_id = F.when(F.col("tree") != "", F.col("tree")).cast("bigint").alias("conv_id")
    return rows.select(conv_id, *schema.names[1:])


def judged(rows: DataFrame) -> DataFrame:
    """Contract columns for all conversations and the added one, read back from the written texts."""
    spark = rows.sparkSession
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    columns = ["conv_id", "turn", "role", "text"]
    nodes = materialize(as_trees(rows.select(*columns).unionByName(added)), "chat-nodes")
    return read_back(materialize(conversations(nodes), "chat-texts"))


JUDGED_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r)
), e as (
  select *, length(role) + length(text) + length('<|turn|><|text|><|end|>') + 1
    + length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|<</?SYS>>'))
    + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|<</?SYS>>')) as n
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id
"""
