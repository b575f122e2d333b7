import hashlib
import random
import re

from wardlake.llm import contamination as c
from wardlake.llm.words import NOT_SPACE, Words

DOCS = "doc_id bigint, text string, item_id string, n_words int"
ITEMS = "item_id bigint, text string, doc_id bigint"


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def brute_force(texts: dict[int, str | None], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The contract columns by plain comparison of every window."""

    def words(text: str | None) -> list[str]:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = {}
    for doc, text in texts.items():
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            theirs = words(passage)
            k = min(c.WINDOW, len(theirs))
            for i in range(len(theirs) - k + 1 if k else 0):
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == theirs[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["Alpha", "beta", "ünd", "中文", "x9", "gamma-delta", "A"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 10, 14])))) for i in range(8)]
    items += [(50, None), (51, ""), (52, "?!"), (53, items[0][1]), (54, "rare passage of exactly ten words stands here for all")]
    docs = {}
    for i in range(30):
        parts = [word() for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(items[:8])[1].upper())
        docs[i] = rng.choice([" ", ", ", "\n"]).join(parts)
    docs |= {90: None, 91: "", 92: "rare passage, of EXACTLY ten words\nstands here for all", 93: "word " * 300_000}
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in docs.items()], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    expected = brute_force({k: v for k, v in docs.items() if k != 93}, items)
    got = rows(c.judged(frame, bench))
    assert got.pop(93)[0] == 300_000
    assert got == expected
    # the same without the broadcast set
    spans = {r.doc_id: (r.spans, r.items) for r in c.find_leaks(frame, bench).collect()}
    parts = {r.doc_id: (r.spans, r.items) for r in c.find_leaks(frame, bench, max_windows=20).collect()}
    assert parts == spans
    kept = {r.doc_id for r in c.clean_documents(frame, bench).collect()}
    assert kept == {k for k, v in expected.items() if not v[4]} | {93}
    assert c.clean_documents(frame, bench).columns == frame.columns
    joined = c.clean_documents(frame, bench, max_windows=20)
    assert joined.columns == frame.columns and sorted(joined.collect()) == sorted(c.clean_documents(frame, bench).collect())


def test_large_benchmark_with_hot_windows_and_copies(spark):
    passage = "this very common passage stands in a third of all documents of the table"
    docs = [(i, f"own {i} words {passage if i % 3 == 0 else 'nothing shared here'} tail {i}") for i in range(300)]
    docs += [(1000 + i, f"One copy of: {passage}") for i in range(150)] + [(None, passage), (5, None), (6, ""), (7, "w " * 50_000)]
    items = [(i, f"question {i} {passage if i % 2 else 'is another one of its own with words enough'} end") for i in range(40)] + [(None, passage)]
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in docs], DOCS).repartition(5)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    plain = sorted(c.find_leaks(frame, bench).collect(), key=repr)
    assert sorted(c.find_leaks(frame, bench, max_windows=0).collect(), key=repr) == plain
    assert sum(bool(r.spans) for r in plain) == 251
    both = [sorted(c.clean_documents(frame, bench, max_windows=n).collect(), key=repr) for n in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == len(docs) - 251


def test_removal_leaves_no_window(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Head words, {passage.upper()}; tail words " * 2, "", 0), (2, passage, "", 0), (3, None, "", 0)], DOCS)
    bench = spark.createDataFrame([(7, passage, 0)], ITEMS)
    got = {r.doc_id: r.text for r in c.remove_leaks(docs, bench, 0.9).collect()}
    assert got == {1: "Head words, ; tail words Head words, ; tail words ", 3: None}
    assert set(rows(c.judged(spark.createDataFrame(got.items(), "doc_id bigint, text string"), bench)).values())
    assert not any(v[4] for v in rows(c.judged(spark.createDataFrame(got.items(), "doc_id bigint, text string"), bench)).values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, "c", "", 0)], DOCS)
    assert c.judged(none, bench).count() == 0
    assert [r.contaminated for r in c.judged(docs, bench).collect()] == [False] * 3


def test_words_by_borders():
    texts = [b"Ab c\tD", None, "é ü x".encode(), b"   "]
    w = Words(texts, NOT_SPACE)
    assert [w.word(i) for i in range(len(w.hashes))] == [b"ab", b"c", b"d", "é ü".encode(), b"x"]
    assert list(w.first) == [0, 3, 3, 5, 5]
    assert len(set(w.hashes.tolist())) == 5
