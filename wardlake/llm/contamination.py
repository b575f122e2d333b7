"""Benchmark decontamination: a broadcast hash set of test n-grams against all training token windows.

Every benchmark item becomes windows of ten consecutive normalised words (an item of fewer words is one window). Tasks
make and hash the windows, Spark groups them to a table of distinct windows with their items. Up to ``MAX_WINDOWS`` of
these form one sorted hash array per window length, sent to the executors. Each task hashes all windows of its documents,
looks them up, verifies every hit word by word, and marks the words inside. Documents are neither shuffled nor cut.

A larger benchmark never leaves the executors: a bit map of its hashes, of fixed size, goes to the tasks; document
windows that pass it are joined with the table on length, hash and words, and what is found comes back to the documents
by a join on their texts. A window that very many documents hold is counted before that join and takes no more than its
share of a task.

Defined results: null and empty texts have no words and are clean; items without words hit nothing; repeated items or
documents are handled row by row; an empty table on either side gives clean documents; null item ids are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.joins import HOT_SHARE, hot_join
from wardlake.llm.words import ALPHANUMERIC, Words, arrow_rows, chunks, keep_rows, window_hashes
from wardlake.session import materialize

WINDOW = 10
# Windows in the broadcast set (8 bytes of hash and some 80 bytes of words each: about 100 MB at most).
MAX_WINDOWS = 1_000_000
# Bits of the map of a larger benchmark: 8 MB, collected as at most 2^20 rows.
MAP_BITS = 26
GRAM = ["k", "hash", "words"]
TEXT = ["t1", "t2"]
# Words as they are counted in a text: upper case belongs to them, as it is folded.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, hash, words, items): every distinct window of ``benchmark`` (item_id, text) with the items it is from."""
    fields = [("k", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item_id", pa.int64())]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                words = Words([text], ALPHANUMERIC)
                n = len(words.hashes)
                k = min(window, n)
                if k:
                    every = [words.word(i) for i in range(n)]
                    grams = [b" ".join(every[i : i + k]) for i in range(n - k + 1)]
                    hashed = window_hashes(words.hashes, k).view(np.int64).tolist()
                    yield {"k": [k] * len(grams), "hash": hashed, "words": grams, "item_id": [item] * len(grams)}

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    found = arrow_rows(rows, run, pa.schema(fields), "k int, hash bigint, words binary, item_id bigint")
    return found.groupBy(*GRAM).agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class NgramSet:
    """Distinct windows: sorted hashes by window length, with the words and the items of each."""

    def __init__(self, windows: list[tuple[int, int, bytes, list[int]]]) -> None:
        by_length: dict[int, list[tuple[int, bytes, list[int]]]] = {}
        for k, hashed, words, items in windows:
            by_length.setdefault(k, []).append((hashed % (1 << 64), bytes(words), list(items)))
        self.lengths = []
        for k, own in sorted(by_length.items()):
            own.sort()
            keys = np.array([hashed for hashed, _, _ in own], dtype=np.uint64)
            self.lengths.append((k, keys, [tuple(words.split(b" ")) for _, words, _ in own], [items for _, _, items in own]))

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[int], list[int]]]:
        """Per text: number of words, hit word ranges as flat (from, to) pairs, ids of the items that occur."""
        for lo, hi in chunks(texts):
            words = Words(texts[lo:hi], ALPHANUMERIC)
            hits: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
            for k, keys, grams, owners in self.lengths:
                hashed = window_hashes(words.hashes, k)
                at = np.searchsorted(keys, hashed)
                at[at == len(keys)] = 0
                for i in np.flatnonzero(keys[at] == hashed):
                    doc = int(np.searchsorted(words.first, i, side="right")) - 1
                    if i + k > words.first[doc + 1]:
                        continue
                    # equal hashes of different windows stand side by side
                    j = int(np.searchsorted(keys, hashed[i]))
                    while j < len(keys) and keys[j] == hashed[i]:
                        if all(words.word(i + n) == w for n, w in enumerate(grams[j])):
                            spans, items = hits.setdefault(doc, ([], set()))
                            spans.append((int(i - words.first[doc]), int(i - words.first[doc]) + k))
                            items.update(owners[j])
                        j += 1
            for doc in range(hi - lo):
                spans, items = hits.get(doc, ([], set()))
                yield int(words.first[doc + 1] - words.first[doc]), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping and touching ranges joined, as flat (from, to) pairs in order."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _windows(benchmark: DataFrame, max_windows: int) -> tuple[DataFrame, Broadcast | None]:
    """The table of windows, and the hash set of all of them if they are few enough."""
    windows = materialize(benchmark_windows(benchmark), "windows")
    if windows.count() > max_windows:
        return windows, None
    rows = [(r.k, r.hash, r.words, r["items"]) for r in windows.collect()]  # at most max_windows
    return windows, windows.sparkSession.sparkContext.broadcast(NgramSet(rows))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, keep_text: bool = False, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``spans`` (flat word ranges hit), ``items`` (sorted item ids).

    ``keep_text`` adds the text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    windows, grams = _windows(benchmark, max_windows)
    return _scanned(rows, grams, keep_text) if grams is not None else _joined(rows, windows, keep_text)


def _scanned(docs: DataFrame, grams: Broadcast, keep_text: bool) -> DataFrame:
    fields = [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.int64())),
        ("items", pa.list_(pa.int64())),
    ]
    ddl = "doc_id bigint, n_words bigint, spans array<bigint>, items array<bigint>"
    if keep_text:
        fields.append(("text", pa.binary()))
        ddl += ", text binary"

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            n_words, spans, items = zip(*grams.value.scan(batch["text"])) if batch["text"] else ((), (), ())
            out = {"doc_id": batch["doc_id"], "n_words": list(n_words), "spans": list(spans), "items": list(items)}
            yield out | {"text": batch["text"]} if keep_text else out

    out = arrow_rows(docs, run, pa.schema(fields), ddl)
    return out.withColumn("text", F.decode("text", "UTF-8")) if keep_text else out


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _hash_map(windows: DataFrame) -> np.ndarray:
    """One bit per leading ``MAP_BITS`` bits of a hash: set where a window has them."""
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    word, bit = F.shiftrightunsigned(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    parts = windows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    for row in parts.toLocalIterator():  # at most 2^20 rows
        out[row.word] = row.bits % (1 << 64)
    return out


def _passing(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(t1, t2, at, k, hash, words) of all windows of the documents whose hash is in the map."""
    spread = docs.sparkSession.sparkContext.broadcast(_hash_map(windows))
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most WINDOW
    fields = [("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int64()), ("k", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        held = spread.value
        for batch in batches:
            for lo, hi in chunks(batch["text"]):
                words = Words(batch["text"][lo:hi], ALPHANUMERIC)
                for k in lengths:
                    hashed = window_hashes(words.hashes, k)
                    place = hashed >> np.uint64(64 - MAP_BITS)
                    found = np.flatnonzero((held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                    doc = np.searchsorted(words.first, found, side="right") - 1
                    whole = found + k <= words.first[doc + 1]
                    found, doc = found[whole], doc[whole]
                    yield {
                        "t1": [batch["t1"][lo + d] for d in doc],
                        "t2": [batch["t2"][lo + d] for d in doc],
                        "at": (found - words.first[doc]).tolist(),
                        "k": [k] * len(found),
                        "hash": hashed[found].view(np.int64).tolist(),
                        "words": [b" ".join(words.word(i + n) for n in range(k)) for i in found],
                    }

    texts = docs.select(*_text_key(F.col("text")), "text").where("text IS NOT NULL")
    return arrow_rows(texts, run, pa.schema(fields), "t1 bigint, t2 bigint, at bigint, k int, hash bigint, words binary")


def _hit_texts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(t1, t2, spans, items) of the distinct texts in which a window occurs."""
    passing = materialize(_passing(docs, windows), "passing-windows")
    counted = passing.groupBy(*GRAM).agg(F.count("*").alias("rows"))
    met = materialize(counted.join(windows, GRAM), "met-windows")
    total = met.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") * HOT_SHARE >= F.lit(total)
    hits = hot_join(passing, met.withColumn("known", F.lit(True)), ["hash", "k", "words"], hot, ["known", "items"])
    hits = hits.where("known").select(*TEXT, "at", "k", "items").distinct()
    # a text has as many hits as it has windows at most, so a group is no larger than its document
    grouped = hits.groupBy(*TEXT).agg(
        F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("k")).alias("to")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last"))

    def step(state: Column, hit: Column) -> Column:
        goes_on = hit.at <= state["last"]
        closed = F.when(goes_on | (state["first"] < 0), state.done).otherwise(F.concat(state.done, F.array(state["first"], state["last"])))
        return F.struct(
            closed.alias("done"),
            F.when(goes_on, state["first"]).otherwise(hit.at).alias("first"),
            F.when(goes_on, F.greatest(state["last"], hit.to)).otherwise(hit.to).alias("last"),
        )

    spans = F.aggregate("hits", start, step, lambda s: F.concat(s.done, F.array(s["first"], s["last"])))
    return materialize(grouped.select(*TEXT, spans.alias("spans"), "items"), "hit-texts")


def _met(docs: DataFrame, windows: DataFrame, values: list[str]) -> DataFrame:
    """``docs`` with ``values`` of its text's hits, null where there are none."""
    hits = _hit_texts(docs, windows)
    keyed = docs.select("*", *_text_key(F.col("text")))
    copies = keyed.groupBy(*TEXT).agg(F.count("*").alias("rows"))
    found = hits.join(copies, TEXT)
    n = docs.count()
    return hot_join(keyed, found, TEXT, F.col("rows") * HOT_SHARE >= F.lit(n), values)


def _joined(docs: DataFrame, windows: DataFrame, keep_text: bool) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return _met(docs, windows, ["spans", "items"]).select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", none).alias("items"),
        *(["text"] if keep_text else []),
    )


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    ends = F.filter("spans", lambda _, i: i % 2 == 1)
    starts = F.filter("spans", lambda _, i: i % 2 == 0)
    zero = F.lit(0).cast("bigint")
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda a, b: a - b), zero, lambda a, b: a + b)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the hit words; what stands between two words of one hit range goes with them."""
    if not text or not spans:
        return text
    raw = text.encode()
    words = Words([raw], ALPHANUMERIC)
    kept, at = [], 0
    for first, last in zip(spans[0::2], spans[1::2]):
        kept.append(raw[at : words.starts[first]])
        at = int(words.ends[last - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5) -> DataFrame:
    """Clean training documents: ``doc_id`` and ``text`` with the hit spans cut out.

    A document of which more than ``max_share`` of the words are hit goes as a whole; 0 drops every hit document.
    """
    found = find_leaks(docs, benchmark, keep_text=True)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            ids, texts = [], []
            for doc, raw, n, spans in zip(batch["doc_id"], batch["text"], batch["n_words"], batch["spans"]):
                hit = sum(spans[1::2]) - sum(spans[0::2])
                if hit <= max_share * n:
                    ids.append(doc)
                    texts.append(None if raw is None else without_spans(raw.decode(), spans))
            yield {"doc_id": ids, "text": texts}

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return arrow_rows(found, run, schema, "doc_id bigint, text string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    windows, grams = _windows(benchmark, max_windows)
    if grams is not None:
        return keep_rows(docs, lambda texts: [not spans for _, spans, _ in grams.value.scan(texts)])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = _met(whole, windows, ["spans"]).where("spans IS NULL")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
