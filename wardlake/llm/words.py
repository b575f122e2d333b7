"""Words of many texts at once, hashed in numpy.

A batch of texts is joined into one byte buffer; word borders come from a table over the bytes and every word's
64-bit hash from prefix sums of a polynomial, so the cost is a few array passes per byte and nothing per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20
# Rows of an Arrow batch turned into lists at once.
PART_ROWS = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# `[^\x20\x09-\x0D]+` after lower-casing A-Z: whatever is not ASCII white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and everything outside ASCII
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = True
ALPHANUMERIC[97:123] = True
ALPHANUMERIC[128:] = True

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        table = np.full(max(n, CHUNK_BYTES + 2), base, dtype=np.uint64)
        table[0] = 1
        known = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(texts: Sequence[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` whose total length stays under ``limit``, or single longer texts."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of ``texts``: ``hashes`` and byte borders of all, ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, texts: Sequence[bytes | None], is_word: np.ndarray) -> None:
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        self.data = LOWER[np.frombuffer(joined, dtype=np.uint8)]
        mask = np.zeros(len(self.data) + 2, dtype=np.int8)
        mask[1:-1] = is_word[self.data]
        turns = np.flatnonzero(mask[1:] != mask[:-1])
        self.starts, self.ends = turns[0::2], turns[1::2]
        self.text_starts = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.text_starts)
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, n)[:n], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * _powers_of(_INVERSE, n + 1)[self.starts]
        self.hashes = mix(raw)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def weights(k: int) -> np.ndarray:
    """Fixed odd factors, one per place in a window of k words."""
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(k)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j, w in enumerate(weights(k)):
        total += hashes[j : j + n] * w
    return mix(total)


def arrow_rows(
    df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict]], schema: pa.Schema, ddl: str
) -> DataFrame:
    """Map Arrow batches: ``fn`` gets parts of them as lists by column (text as bytes) and yields columns of ``schema``.

    Parts hold at most ``PART_ROWS`` rows, so that a worker copies little of a batch at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS))
        for out in fn(as_lists(part) for part in parts):
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        release_memory()

    return df.mapInArrow(run, ddl)


def release_memory() -> None:
    """Give what a finished task has freed back to the system; workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def as_lists(batch: pa.RecordBatch) -> dict[str, list]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_string(column.type):
            column = column.cast(pa.binary())
        elif pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        out[name] = column.to_pylist()
    return out


def keep_rows(df: DataFrame, keep: Callable[[list[bytes | None]], Sequence[bool]], text: str = "text") -> DataFrame:
    """Rows whose texts ``keep`` accepts, batch by batch, with all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            texts = as_lists(part.select([text]))[text]
            yield part.filter(pa.array([bool(k) for k in keep(texts)], pa.bool_()))
        release_memory()

    return df.mapInArrow(run, df.schema)
