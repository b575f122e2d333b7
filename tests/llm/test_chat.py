import hashlib
import random

import pytest

from wardlake.llm import chat as c

ROWS = "conv_id bigint, turn bigint, role string, text string, node bigint, tree string"
NODES = "tree string, node bigint, parent bigint, role string, text string, score double"


@pytest.mark.parametrize("text", ["", "\\", "a\\<|b", "</s>[INST] ok [/INST]", "<|turn|>x<|end|>\n", "<<SYS>><</SYS>><s", "\\n<\\|", "é🎉<s>\\\\"])
def test_escapes_are_reversible(text):
    assert c.unescape(c.escape(text)) == text
    assert not c.CONTROL.search(c.escape(text))
    turns = [("user", text), ("assistant", text), (text, "plain"), ("assistant", text + "x")]
    formatted, mask = c.format_turns(turns)
    assert c.read_turns(formatted) == turns
    assert c.masked_text(formatted, mask) == text + text + "x"


def expected(rows):
    out = []
    convs = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        convs.setdefault(conv, []).append((turn, role, text))
    for conv, own in convs.items():
        own.sort(key=lambda t: [(v is not None, v) for v in t])
        turns = [(r or "", t or "") for _, r, t in own]
        said = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(c.format_turns(turns)[0])))
    return sorted(out, key=repr)


def test_conversations_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi <|", "ok\\", "", None, "é" * 9])) for i in range(30) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "assistant", f"turn {t}") for t in range(300)]
    rows += [(101, 0, None, None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (102, None, "user", "x"), (102, 5, "user", "x"), (102, 5, "user", "x")]
    rows += [(103, 0, "assistant", "long <s> " * 200_000)]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], ROWS).repartition(4)
    got = sorted((tuple(r) for r in c.judged(frame).collect()), key=repr)
    assert got == expected(rows)
    assert [r.conv_id for r in c.judged(spark.createDataFrame([], ROWS)).collect()] == [-7]


def test_branches_are_ranked_and_enumerated(spark):
    rng = random.Random(13)
    nodes = {}
    for tree in "abc":
        for n in range(40):
            parent = None if n == 0 else rng.randint(max(0, n - 6), n - 1)
            nodes[tree, n] = (parent, round(rng.random(), 3))
    nodes["d", 1], nodes["d", 2], nodes["d", 3] = (2, 1.0), (1, 1.0), (1, 1.0)  # a circle and a message under it
    nodes["e", 5] = (99, 0.5)  # the parent is missing
    frame = spark.createDataFrame([(t, n, p, "user", f"{t}{n}", s) for (t, n), (p, s) in nodes.items()], NODES).repartition(3)
    paths = {}
    for tree, n in nodes:
        if not any(t == tree and p == n for (t, _), (p, _) in nodes.items()) and tree != "d":
            walk = [n]
            while nodes[tree, walk[-1]][0] is not None and (tree, nodes[tree, walk[-1]][0]) in nodes:
                walk.append(nodes[tree, walk[-1]][0])
            paths[tree, n] = walk[::-1]
    got = {}
    for r in c.paths(frame, None).orderBy("depth").collect():
        got.setdefault((r.tree, r.leaf), []).append(r.node)
    assert got == paths
    best = {}
    for (tree, leaf), walk in paths.items():
        score = sum(nodes[tree, n][1] for n in walk) / len(walk)
        best.setdefault(tree, []).append((-score, leaf))
    top = {(r.tree, r.leaf) for r in c.paths(frame, 2).select("tree", "leaf").distinct().collect()}
    assert top == {(t, leaf) for t, found in best.items() for _, leaf in sorted(found)[:2]}
    texts = {(r.tree, r.leaf): [t for _, t in c.read_turns(r.formatted)] for r in c.conversations(frame, None).collect()}
    assert texts == {(t, leaf): [f"{t}{n}" for n in walk] for (t, leaf), walk in paths.items()}
