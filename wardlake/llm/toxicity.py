"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded words, normalised by length, with exceptions.

Folding turns homoglyphs of other alphabets and digits or signs written for letters into plain letters; a sign at a
word's border is read both as a letter and as no part of the word. The lexicon holds whole words and word beginnings
that are much commoner in toxic documents, by more than chance explains; an entry's weight is the logarithm of that
ratio. Words are found and hashed as arrays, each distinct word is folded and matched once per worker, and the
weights of a document's words are added up and divided by its length. A hit inside an exception phrase does not count.
A logistic curve over this density gives the score.

Learning reads at most ``TRAIN_ROWS`` labelled documents outside the held-out third, chosen by hash, which bounds the
entries whatever the size of the corpus. The toxic ones among them are counted first; an entry in so few of them that it
could not pass even if no other document held it goes no further, the others are counted in the other documents too and
compared in Spark. What goes to the executors in the end is the lexicon. Scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts have no words and get the score of zero density; documents without a label are
scored like others; a document labelled more than once counts as toxic if any label says so; without labelled rows of
both kinds the default lexicon decides; rows without doc_id are scored and belong to the held-out side.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.words import ALPHANUMERIC, Words, arrow_rows, chunks, keep_rows, release_memory
from wardlake.session import materialize

# Most labelled documents that the lexicon is learned from.
TRAIN_ROWS = 50_000
# An entry occurs in at least so many toxic documents.
MIN_DOCUMENTS = 3
# Least logarithm of how much commoner an entry is in toxic documents, and how many of its standard errors are above 0.
MIN_WEIGHT, SURE = 2.0, 3.0
# Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6)
STEM_GAIN = 1.3
MIN_WORD, MAX_WORD = 3, 40
# Words added to a document's length, so that one hit in a few words is no certainty.
LENGTH_OFFSET = 20
THRESHOLD = 0.7
MAX_KNOWN_WORDS = 1_000_000

# Weight that words of the default lexicon have at least.
DEFAULT_WEIGHT = 3.0
DEFAULT_LEXICON = ("asshole", "bastard", "bitch", "clown", "disgusting", "dumbass", "fuck", "fucking", "idiot", "imbecile")
DEFAULT_LEXICON += ("loser", "moron", "pathetic", "scum", "shithead", "stupid", "trash", "worthless")
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "recycle trash", "sore loser", "keep it simple stupid")
# Places around a hit in which an exception phrase is looked for: one less than the longest phrase has words.
AROUND = 3

# Letters of other alphabets that look like Latin ones, and digits and signs written for letters.
CYRILLIC = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
}
GREEK = {
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w",
}
ARMENIAN = {"ց": "g", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "զ": "q", "ա": "w", "յ": "j"}
# capitals whose small letter looks like another one
CAPITALS = {
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t",
    "Υ": "y", "Χ": "x", "Տ": "s", "Լ": "l",
}
LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ſ": "s"}
HOMOGLYPHS = CYRILLIC | GREEK | ARMENIAN | LATIN
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_FOLD = str.maketrans(HOMOGLYPHS)
_CAPITALS = str.maketrans(CAPITALS)
_SIGNS = str.maketrans(SIGNS)
# words also hold the two signs that stand for letters
_WORD = ALPHANUMERIC.copy()
_WORD[[ord("@"), ord("$")]] = True


def fold(word: str) -> str:
    """A word as the lexicon sees it, signs read as letters; without any letter it stays, but for signs at its ends."""
    if word.isascii():
        word = word.lower()
    else:
        word = re.sub(r"^[^\w@$]+|[^\w@$]+$", "", word).translate(_CAPITALS).lower().translate(_FOLD)
    if word.isalpha():
        return word
    return word.translate(_SIGNS) if any(c.isalpha() for c in word) else word.strip("@$")


def readings(word: str) -> list[str]:
    """The folded word, and where signs stand at its ends also without these: ``@name``, ``$word$``."""
    bare = word.strip("@$")
    return [fold(word)] if bare == word else list(dict.fromkeys((fold(word), fold(bare), fold(word.rstrip("@$")))))


def features(word: str) -> list[str]:
    """What can become an entry for a folded word: itself and its beginnings."""
    if not MIN_WORD <= len(word) <= MAX_WORD or not word.isalpha():
        return []
    return [f"^{word}$", *(f"^{word[:n]}" for n in STEMS if len(word) > n)]


class Lexicon:
    """Weights of entries, ``^word$`` or ``^beginning``, and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> None:
        self.weights = weights
        self.exceptions = tuple(" ".join(map(fold, e.split())) for e in exceptions)
        self._match = self._excuse = None
        self._keys = np.zeros(0, dtype=np.uint64)
        self._values = np.zeros(0)

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _automata(self) -> None:
        self._match, self._excuse = ahocorasick.Automaton(), ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self._match.add_word(entry, weight)
        for phrase in self.exceptions:
            self._excuse.add_word(f" {phrase} ", len(phrase))
        self._match.make_automaton()
        self._excuse.make_automaton()

    def weight(self, folded: str) -> float:
        """Of a word's entries the one that weighs most."""
        if not self.weights:
            return 0.0
        if self._match is None:
            self._automata()
        return max((w for _, w in self._match.iter(f"^{folded}$")), default=0.0)

    def word_weight(self, word: str) -> float:
        return max(map(self.weight, readings(word)))

    def _word_weights(self, words: Words) -> np.ndarray:
        distinct, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self._keys) + len(distinct) > MAX_KNOWN_WORDS:
            self._keys, self._values = self._keys[:0], self._values[:0]
        at = np.searchsorted(self._keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == distinct[inside]
        fresh = [self.word_weight(words.word(i).decode()) for i in sample[~known]]
        self._keys = np.insert(self._keys, at[~known], distinct[~known])
        self._values = np.insert(self._values, at[~known], fresh)
        return self._values[np.searchsorted(self._keys, distinct)][which]

    def _excused(self, words: Words, hit: int, first: int, last: int) -> bool:
        """Whether an exception phrase covers word ``hit`` of the document with words first..last."""
        lo, hi = max(first, hit - AROUND), min(last, hit + AROUND + 1)
        around = [fold(words.word(i).decode()) for i in range(lo, hi)]
        text = f" {' '.join(around)} "
        begin = len(" ".join(around[: hit - lo])) + (hit > lo) + 1
        return any(end - length <= begin < end for end, length in self._excuse.iter(text))

    def densities(self, texts: list[bytes | None]) -> Iterator[float]:
        """Per text the weights of its hits over its length."""
        for lo, hi in chunks(texts):
            words = Words(texts[lo:hi], _WORD)
            weights = self._word_weights(words)
            if self.exceptions:
                hits = np.flatnonzero(weights)
                docs = np.searchsorted(words.first, hits, side="right") - 1
                for hit, doc in zip(hits, docs):
                    if self._excused(words, int(hit), int(words.first[doc]), int(words.first[doc + 1])):
                        weights[hit] = 0.0
            sums = np.concatenate([[0.0], np.cumsum(weights)])
            totals = sums[words.first[1:]] - sums[words.first[:-1]]
            # without hits exactly zero, whatever rounding the running sums have
            count = np.concatenate([[0], np.cumsum(weights > 0)])
            totals[count[words.first[1:]] == count[words.first[:-1]]] = 0.0
            yield from (totals / (np.diff(words.first) + LENGTH_OFFSET)).tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out third; labels are few, so broadcast."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    by_doc = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a rough share by hash first, so that few labels are sorted however many there are
    share = F.lit(int(1.2 * rows / max(1, by_doc.count()) * (1 << 30)))
    few = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share)
    chosen = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _document_counts(rows: DataFrame, candidates: frozenset[str] | None) -> DataFrame:
    """(entry, n): in how many texts an entry, among ``candidates`` if given, occurs."""
    schema = pa.schema([("entry", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        known: dict[bytes, list[str]] = {}
        for batch in batches:
            total: Counter[str] = Counter()
            for lo, hi in chunks(batch["text"]):
                words = Words(batch["text"][lo:hi], _WORD)
                for doc in range(hi - lo):
                    own: set[str] = set()
                    for word in {words.word(i) for i in range(words.first[doc], words.first[doc + 1])}:
                        found = known.get(word)
                        if found is None:
                            found = [f for reading in readings(word.decode()) for f in features(reading)]
                            if candidates is not None:
                                found = [f for f in found if f in candidates]
                            if len(known) < MAX_KNOWN_WORDS // 16:
                                known[word] = found
                        own.update(found)
                    total.update(own)
            yield {"entry": list(total), "n": list(total.values())}

    counts = arrow_rows(rows.select("text"), run, schema, "entry string, n bigint")
    return counts.groupBy("entry").agg(F.sum("n").alias("n"))


def weight_and_error(n: int, other: int, toxic: int, clean: int) -> tuple[float, float]:
    """Logarithm of how much commoner an entry of ``n`` toxic and ``other`` clean documents is in toxic ones, and its
    standard error."""
    ratio = (n + 0.5) / (toxic + 1) / ((other + 0.5) / (clean + 1))
    return math.log(ratio), math.sqrt(1 / (n + 0.5) + 1 / (other + 0.5))


def _passes(weight: float, error: float) -> bool:
    return weight >= MIN_WEIGHT and weight >= SURE * error


def learn(training: DataFrame) -> Lexicon:
    """Lexicon from (text, toxic) rows, on top of the default one."""
    sizes = {r.toxic: r.n for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = {f"^{word}$": DEFAULT_WEIGHT for word in DEFAULT_LEXICON}
    possible = [n for n in range(MIN_DOCUMENTS, toxic + 1) if _passes(*weight_and_error(n, 0, toxic, clean))] if clean else []
    if not possible:
        return Lexicon(weights)
    found = _document_counts(training.where("toxic = 1"), None).where(F.col("n") >= possible[0]).collect()
    in_toxic = {r.entry: r.n for r in found}
    in_clean = {r.entry: r.n for r in _document_counts(training.where("toxic = 0"), frozenset(in_toxic)).collect()}
    kept: dict[str, int] = {}
    said: Counter[str] = Counter()  # by beginning, the most documents that a longer kept entry is in
    for entry in sorted(in_toxic, key=lambda e: (-len(e), e)):
        n = in_toxic[entry]
        weight, error = weight_and_error(n, in_clean.get(entry, 0), toxic, clean)
        # a beginning says more than one word only if it is in clearly more documents than any longer entry
        if _passes(weight, error) and n >= STEM_GAIN * said[entry]:
            kept[entry] = n
            weights[entry] = max(weights.get(entry, 0.0), weight)
            for length in STEMS:
                said[entry[: length + 1]] = max(said[entry[: length + 1]], n)
    return Lexicon(weights)


def with_density(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``density`` of every row."""
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(*keep, "text")
    kept = rows.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            density = pa.array(list(spread.value.densities(texts)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), density], names=[*keep, "density"])
        release_memory()

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "density double"]))


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the logarithm of density, by Newton steps; points are
    (log density, toxic, number of documents)."""
    if len({y for _, y, _ in points}) < 2:
        return 4.0, -2.0
    x, y, n = (np.array(v, dtype=float) for v in zip(*points))
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta, ridge = np.zeros(2), np.diag([1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge @ theta
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + ridge
        theta = theta + np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(max(theta[0], 0.0)), float(theta[1])


def log_density(density: Column) -> Column:
    return F.log1p(density * 100)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Lexicon, float, float]:
    """Lexicon, slope and offset learned from at most ``rows`` labelled documents."""
    training = materialize(training_rows(docs, labels, rows), "toxicity-training")
    lexicon = learn(training)
    x = F.round(log_density(F.col("density")), 2).alias("x")
    points = with_density(training, lexicon, "toxic").groupBy(x, "toxic").agg(F.count("*").alias("n"))
    return lexicon, *fit_curve([(r.x, r.toxic, r.n) for r in points.collect()])


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every document."""
    lexicon, slope, offset = fit(docs, labels, rows)
    score = 1 / (1 + F.exp(-(F.lit(slope) * log_density(F.col("density")) + F.lit(offset))))
    return with_density(docs, lexicon, *keep).select(*keep, score.alias("score"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns per document: doc_id, held_out, score, predicted."""
    done = scored(docs, labels, TRAIN_ROWS, "doc_id")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score is under ``threshold``, with all their columns and without a shuffle."""
    lexicon, slope, offset = fit(docs, labels)
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)

    def clean(texts: list[bytes | None]) -> list[bool]:
        scores = (slope * math.log1p(100 * density) + offset for density in spread.value.densities(texts))
        return [1 / (1 + math.exp(-score)) < threshold for score in scores]

    return keep_rows(docs, clean)
