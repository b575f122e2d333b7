import random
import zlib

import pytest

from wardlake.llm import toxicity as t

DOCS = "doc_id bigint, text string, score string, density int, toxic int"
LABELS = "doc_id bigint, toxic int, text string"


DISGUISES = {
    "1D10T": "idiot", "іdіоt": "idiot", "idiοt": "idiot", "ιdιοτ": "idiot", "IDІОТ": "idiot", "mοrοn": "moron", "ΜΟRΟΝ": "moron",
    "αsshοle": "asshole", "@sshole": "asshole", "sсυm": "scum", "$cum": "scum", "$tupid": "stupid", "stup1d": "stupid",
    "Տtupid": "stupid", "p@thetic": "pathetic", "lоѕеr": "loser", "tra$h": "trash", "cӏown": "clown", "wοrthlеss": "worthless",
    "ԁumba$$": "dumbass", "ЅСUM": "scum", "f\u1d0f\u1d0fl": "fool", "lօser": "loser", "sհithead": "shithead",
}


def test_folding():
    for letter, latin in t.HOMOGLYPHS.items():
        assert t.fold(f"x{letter}x") == f"x{latin}x"
        assert not letter.isascii() and latin.isascii() and len(latin) == 1 and letter == letter.lower()
    for letter, latin in t.CAPITALS.items():
        assert t.fold(f"X{letter}X") == f"x{latin}x" and letter.isupper()
    for sign, latin in t.SIGNS.items():
        assert t.fold(f"x{sign}x") == f"x{latin}x"
    for disguised, word in DISGUISES.items():
        assert t.fold(disguised) == word, disguised
    assert t.fold("12345") == "12345" and t.fold("$100") == "100" and t.fold("«Été»") == "été" and t.fold("$$") == ""
    assert t.fold("idiot$") == "idiots" and t.readings("@idiot") == ["aidiot", "idiot"]
    assert t.readings("$tupid$") == ["stupids", "tupid", "stupid"] and t.readings("plain") == ["plain"]


def test_disguises_of_default_words_are_found():
    lexicon = t.Lexicon({f"^{w}$": t.DEFAULT_WEIGHT for w in t.DEFAULT_LEXICON})
    for disguised, word in DISGUISES.items():
        if word in t.DEFAULT_LEXICON:
            assert next(lexicon.densities([f"you {disguised} there".encode()])) > 0, disguised
    for text in ("you @idiot", "you $tupid$", "you idiot$$", "a $100 note", "mail a@b"):
        assert (next(lexicon.densities([text.encode()])) > 0) == ("idiot" in text or "tupid" in text), text


def plain(lexicon, text):
    """The density by words, one at a time."""
    import re

    raw = re.findall(r"[0-9A-Za-z@$\x80-\U0010ffff]+", text or "")
    words = [t.fold(w) for w in raw]
    total = 0.0
    for i, w in enumerate(words):
        excused = any(words[i - k : i - k + len(e.split())] == e.split() for e in lexicon.exceptions for k in range(len(e.split())) if i >= k)
        if not excused:
            total += max((v for e, v in lexicon.weights.items() for r in t.readings(raw[i]) if f"^{r}$".startswith(e)), default=0.0)
    return total / (len(words) + t.LENGTH_OFFSET)


def test_densities_against_plain_matching():
    rng = random.Random(16)
    lexicon = t.Lexicon({"^trash$": 3.0, "^idio": 2.0, "^idiot$": 5.0, "^clown$": 1.5})
    words = ["trash", "can", "TR4SH", "idiots", "Idiot!", "class", "clown", "fish", "ordinary", "été", "ord", "$$", "idi", "@idiot", "idiοt$"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["", "trash", "trash can", "class clown fish trash", "idiot " * 200_000]
    got = list(lexicon.densities([x.encode() for x in texts] + [None]))
    assert got[-1] == 0.0
    assert got[-2] == pytest.approx(5.0 * 200_000 / 200_020)
    assert got[:-2] == pytest.approx([plain(lexicon, x) for x in texts[:-1]])
    assert got[-4] == 0.0  # excused


def test_learned_lexicon_on_held_out_documents(spark):
    rng = random.Random(17)
    neutral = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    insults = ["glorp", "snarfing"] + [f"zorb{x}" for x in ("el", "an", "ish", "ot", "um", "ik", "ag")]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(neutral) for _ in range(rng.randint(20, 90))]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(insults))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "glorp glorp glorp glorp glorp"), (5002, "glorp zorbel " * 50_000), (5002, "worda")]
    frame = spark.createDataFrame([(*r, "s", 1, 1) for r in rows], DOCS).repartition(4)
    marks = spark.createDataFrame([(*r, "s") for r in labels] + [(0, 1, ""), (7, None, ""), (None, 1, "")], LABELS)
    got = t.judged(frame, marks).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) > 200
    by_id = {r.doc_id: r for r in got if r.doc_id != 5002}
    assert by_id[5000].predicted == by_id[5001].predicted == 0 and by_id[None].predicted == 1
    kept = t.clean_documents(frame, marks)
    assert kept.columns == frame.columns
    assert kept.count() == sum(1 - r.predicted for r in got)


def test_words_of_few_documents_are_learned(spark):
    """Toxic words that are each in one in a hundred toxic documents only."""
    insults = [f"zib{a}{b}q" for a in "bcdfghjklm" for b in "aeiouwyzxv"]
    rows = [(f"plain word number {i % 50} and {insults[i % 100]} again", 1) for i in range(1000)]
    rows += [(f"plain word number {i % 50} and more again", 0) for i in range(3000)]
    frame = spark.createDataFrame(rows, "text string, toxic int").repartition(4)
    weights = t.learn(frame).weights
    assert all(t.Lexicon(weights).weight(w) > 2 for w in insults)
    assert all(t.Lexicon(weights).weight(w) == 0 for w in ("plain", "word", "again", "more"))


def test_default_lexicon_without_labels(spark):
    frame = spark.createDataFrame([(1, "you idiot, you moron", "", 0, 0), (2, "a fine day", "", 0, 0)], DOCS)
    got = {r.doc_id: r.predicted for r in t.judged(frame, spark.createDataFrame([], LABELS)).collect()}
    assert got == {1: 1, 2: 0}
    assert t.judged(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
