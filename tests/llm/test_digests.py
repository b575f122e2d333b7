import hashlib
import random

from wardlake.llm import digests as d

DOCS = "doc_id bigint, text string, block int, fingerprint string"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = (text[: len(text) - n] + after[:n]).encode()
        prints = d.digest(text.encode()), d.digest(edited), d.digest(after.encode())
        near = d.likeness(prints[0], prints[1]), d.likeness(prints[0], prints[2])
        out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), prints[0], prints[1], *near))
    return out


def check(spark, rows, block_bytes):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(5)
    got = [tuple(r) for r in d.against_neighbours(frame, block_bytes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(rows)))


def test_neighbours_over_blocks(spark):
    rng = random.Random(1)
    rows = [(i * 7 - 40, "".join(rng.choice("abcdé \n中") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (5_000_000_000, "x"), (5_000_000_001, "é" * 40)]
    check(spark, rows, 200)
    check(spark, rows, 10**9)


def test_neighbours_with_skewed_ids(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n中") for _ in range(rng.randint(0, n)))
    check(spark, [(i, text(60)) for i in range(80)] + [(1 << 60, "far away"), (-(1 << 61), "before all")], 300)
    check(spark, [(7, text(60)) for _ in range(60)] + [(8, "end")], 300)
    check(spark, [(None, text(60)) for _ in range(60)] + [(i, text(60)) for i in range(20)], 300)


def test_edges(spark):
    check(spark, [(3, "only one text")], 100)
    check(spark, [], 100)
    check(spark, [(None, "no id"), (1, "b" * 50), (1, "a" * 50), (1, "a" * 50), (2, "end")], 64)


def test_digest_properties():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    close = base[:1000] + "zz" + base[1000:]
    other = "".join(rng.choice("qrstuvwxyz 0123456789") for _ in range(4000))
    a, b, c = (d.digest(t.encode()) for t in (base, close, other))
    assert d.likeness(a, a) == 1.0
    assert d.likeness(a, b) > 0.8 > 0.2 > d.likeness(a, c)
    assert d.difference(a, c) == d.difference(c, a) <= d.MAX_DIFFERENCE
    long = (base * 700).encode()
    whole = d.bucket_counts(long)
    assert whole.sum() == len(long) - 2  # no triplet lost or counted twice at the piece borders
    assert d.bucket_counts(b"ab").sum() == 0


def test_plain_fingerprints(spark):
    frame = spark.createDataFrame([(1, "abc abc", 0, ""), (2, None, 0, ""), (3, "abc abc", 0, "")], DOCS)
    got = {r.doc_id: r.fingerprint for r in d.fingerprints(frame).collect()}
    assert got[1] == got[3] == d.digest(b"abc abc") and got[2] == d.digest(b"")
