import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wardlake.llm import packing as p
from wardlake.llm.tokens import WordTokenizer

DOCS = "doc_id bigint, text string, start int, ids string"
PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)

HARD = [
    "Hello, World!  don't it's we'll 12345 a1b2",
    "It's <|endoftext|> and <|ENDOFTEXT|> and <|startoftext|>x",
    "H̱ T̈x İ J̌ é É Å",
    "Straße ΣΑΣ Σ, ÉÈ é, »é«. (foo). x). ... !!! ?!|",
    "a b c　d\x1ce\x85f   g",
    "中文字符, emoji 🎉🎉 ok\U0001f468‍\U0001f469",
    "\n\t\x0b\x0c\r ",
    "",
    "x" * 5000 + " " + "ab9-" * 300,
    "' 's 'S don'T. a's. 'll",
    "é. Été… naïve‘s’ don’t",
]


def reference(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    words = WordTokenizer(PATH)
    rng = random.Random(8)
    texts = [*HARD, *("".join(rng.choice("abcXYZ é.,'|*1 \n»-") for _ in range(200)) for _ in range(300))]
    for _ in range(2):  # the second time from memory
        got = words.encode([t.encode() for t in texts] + [None])
        assert [g.tolist() for g in got] == [*map(reference, texts), []]


def check_pieces(rows, docs, window=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        ids = np.array([*reference(text), 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_pieces_cover_every_document_once(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "zz9"]) for _ in range(rng.choice([3, 40, 900, 5000])))) for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(HARD)] + [(200, None)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(3)
    check_pieces(p.judged(frame).collect(), docs)
    assert p.judged(spark.createDataFrame([], DOCS)).count() == 0


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(10)
    packer = p.LevelPacker(64)
    for i in range(400):
        size = rng.randint(1, 70)
        before = packer.levels.copy()
        closed = list(packer.add(i, np.arange(size, dtype="<u4")))
        rest = size % 64
        if not rest:
            continue
        options = []
        for h in [0, *np.flatnonzero(before)]:
            if h + rest <= 64:
                after = before.copy()
                after[h] -= h > 0
                after[h + rest] += h + rest < 64
                options.append(int((after**2).sum()))
        assert int((packer.levels**2).sum()) == min(options)
        assert all(sum(len(q[2]) for q in w) == 64 for w in closed)
    sizes = [sum(len(q[2]) for q in w) for w in packer.finish()]
    assert all(s & (s - 1) == 0 for s in sizes) and not packer.levels.any()
