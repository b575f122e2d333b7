import hashlib
import random
import re
import zlib

import pytest

from wardlake.llm import contraction
from wardlake.llm import tries as t

ROWS = "conv_id bigint, turn bigint, role string, text string, id string, parent int"


def forest_sums(rows):
    kids, own = {}, {i: v for i, _, v in rows}
    for i, p, _ in rows:
        kids.setdefault(p if p in own else None, []).append(i)
    order = list(kids.get(None, []))
    for i in order:
        order += kids.get(i, [])
    total = dict(own)
    for i in reversed(order):
        total[i] = own[i] + sum(total[k] for k in kids.get(i, []))
    return total


def sums_of(spark, rows):
    frame = spark.createDataFrame([(i, p, v, 1) for i, p, v in rows], "id bigint, parent bigint, v bigint, n bigint")
    return {r.id: r.v for r in contraction.subtree_sums(frame, ["v"]).collect()}


def shapes():
    rng = random.Random(3)
    yield "random", [(i, rng.randrange(i) if i else None, rng.randrange(9)) for i in range(300)]
    yield "chain", [(i, i - 1 if i else None, i) for i in range(130)]
    yield "star", [(i, 0 if i else None, 1) for i in range(200)]
    yield "caterpillar", [(i, None if i == 0 else i - 2 if i % 2 else max(0, i - 2), 2) for i in range(80)]
    yield "forest", [(1, None, 5), (2, 99, 7), (3, 2, 1), (4, 3, 1), (5, 4, 1)]
    yield "one", [(7, None, 3)]
    yield "none", []


@pytest.mark.parametrize("rows", [pytest.param(rows, id=name) for name, rows in shapes()])
def test_subtree_sums(spark, rows):
    assert sums_of(spark, rows) == forest_sums(rows)


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        sums_of(spark, [(1, None, 1), (2, 4, 1), (3, 2, 1), (4, 3, 1)])


def expected(rows, heads=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, key, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    convs = dict(own)
    if heads:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            giver = c - (c % 20 if c >= 0 else -(-c % 20))
            convs[c] = own.get(giver, [])[:h] + own[c][h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        todo = [path]
        for p in todo:
            todo += children.get(p, [])
        return todo

    out = []
    for path, ids in members.items():
        under = below(path)
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) * (len(members[p]) - 1) if p else 0 for p in under]
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        out.append((
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, [])),
            sum(p not in children for p in under), sum(words), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
    assert sorted(map(tuple, t.shared_head_trie(frame).collect()), key=repr) == expected(rows)
    assert sorted(map(tuple, t.conversation_trie(frame).collect()), key=repr) == expected(rows, heads=False)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "ID_STRING", 5)
    monkeypatch.setattr(t, "RUN_TURNS", 4)
    rng = random.Random(8)
    rows = [(c, n, rng.choice(["user", "assistant"]), rng.choice(["hi there", "ok", "", None])) for c in range(70) for n in range(rng.randint(1, 7))]
    rows += [(1000 + c, n, "user", "the same  words\there") for c in range(60) for n in range(3)]
    rows += [(500, n, "user", f"long {n}") for n in range(40)]
    rows += [(None, 0, "user", "no id"), (-7, None, None, None), (-7, 3, "a", "b"), (-7, 3, "a", "b"), (-20, 1, "user", "x y"), (-21, 0, "user", "z")]
    check(spark, rows)


def test_edges(spark):
    check(spark, [])
    check(spark, [(None, 0, "user", "x")])
    check(spark, [(3, 0, None, None)])
