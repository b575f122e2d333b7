import hashlib
import random

import numpy as np
import pytest

from wardlake.llm import lines
from wardlake.llm.cuckoo import CuckooFilter

DOCS = "doc_id bigint, text string, k1 string, n_chars bigint, positions int"
WHITE = " \t\n\x0b\x0c\r"


def kept_texts(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        gone = [doc is not None and len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != doc for x in every]
        kept = "\n".join(x for x, g in zip(every, gone) if not g)
        out.append((doc, len(every), sum(gone), kept))
    return out


def expected(rows):
    return sorted(((d, n, lost, hashlib.sha256(kept.encode()).hexdigest()) for d, n, lost, kept in kept_texts(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 1) for r in rows], DOCS).repartition(4)


def sample(rng, ids):
    pool = ["Shared LINE one", "  shared line ONE\t", "short", "Ünïcode line twelve", "another line here", "", "x" * 10]
    return [(i, "\n".join(rng.choice([*pool, f"own line of {i} {rng.random()}"]) for _ in range(rng.randint(0, 6)))) for i in ids]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot_share", [4, 20_000])
def test_against_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(lines, "HOT_SHARE", hot_share)
    rows = sample(random.Random(3), range(80))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "Shared LINE one\nShared LINE one"), (None, "shared line one")]
    rows += [(204, "a repeated row\nShared line one")] * 2 + [(204, "same id, other text\nshared line one")]
    rows += [(205, "\n".join(f"very long text line {i % 5000}" for i in range(20_000))), (206, "very long text line 4999")]
    assert got(lines.judged(frame(spark, rows))) == expected(rows)
    clean = lines.clean_documents(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns
    left = clean.collect()
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None)
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == sorted(
        (d or -1, kept) for d, _, lost, kept in kept_texts(rows) if not lost or kept.strip(WHITE)
    )  # only those that lost all they said are gone
    assert got(lines.judged(frame(spark, []))) == []


def test_insertions_and_deletions_are_reversible(spark):
    rng = random.Random(4)
    old, new = sample(rng, range(0, 40)), sample(rng, range(40, 80))
    start = lines.LineIndex.build(frame(spark, old), shards=4)
    more = start.insert(frame(spark, new)).insert(frame(spark, new[:5]))
    back = more.delete(frame(spark, new).select("doc_id"))

    def exact(index):
        return got(index.counts().select("k1", "k2", "n_docs", "first_doc"))

    assert exact(more) == exact(lines.LineIndex.build(frame(spark, old + new), shards=4))
    assert exact(back) == exact(start) != exact(more)
    assert got(back.refs().select("doc_id", "k1", "k2")) == got(start.refs().select("doc_id", "k1", "k2"))
    for index in (start, more, back):
        repeated = index.repeated().select("k1", "k2")
        assert got(index.maybe_repeated(repeated)) == got(repeated)
    gone = more.delete(frame(spark, old).select("doc_id"))
    assert exact(gone) == exact(lines.LineIndex.build(frame(spark, new), shards=4))
    done = lines.deduplicated(frame(spark, old + new), more)
    assert sorted((r.row.doc_id, r.n_dropped) for r in done.collect()) == sorted((d, n) for d, _, n, _ in expected(old + new))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    known = CuckooFilter.of(keys)
    assert known.contains(keys).all() and known.load() <= 0.8
    others = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    assert known.contains(others).mean() < 0.001
    known.delete(keys[:20_000])
    assert known.contains(keys[20_000:]).all() and known.contains(keys[:20_000]).mean() < 0.001
    known.insert(keys[:20_000])
    again = CuckooFilter.from_bytes(known.to_bytes())
    assert again.contains(keys).all() and again.load() == known.load()
    known.delete(keys)
    assert known.load() == 0
