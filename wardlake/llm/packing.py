"""Sum-of-squares online packing of tokenized documents into windows.

Every partition packs its documents as they come, without a shuffle. Whole windows are cut from a long document first;
the piece that is left goes to the fill level, among those with an open window that has room or a new window, that
minimises the sum over levels of the squared number of open windows. A level array holds these numbers.

When a partition ends, the windows still open are taken in order of level and joined, cutting freely, into whole
windows; the last one is cut into sequences whose lengths are powers of two, which need no padding.

Windows depend only on their partition's rows in order, so a repeated task packs the same. Sequence ids carry the
partition. Open windows alone are held in memory.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; an empty table has no
sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.tokens import TOKENIZER, word_tokenizer
from wardlake.llm.words import arrow_rows, chunks

WINDOW = 4096
END_ID = 2
# Sequence ids: the partition in the upper bits, a count below.
PARTITION_SHIFT = 36

# (doc_id, start, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class LevelPacker:
    """Packs pieces into windows of ``window`` tokens; ``add`` and ``finish`` yield closed windows as piece lists."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, w = len(ids), self.window
        whole = n - n % w
        for start in range(0, whole, w):
            yield [(doc_id, start, ids[start : start + w], n)]
        if whole < n:
            yield from self._place((doc_id, whole, ids[whole:], n))

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        size, w, levels = len(piece[2]), self.window, self.levels
        # moving one window from h to h + size changes the sum of squares by 2 * (levels[h + size] - levels[h]) + 2
        change = 2 * (levels[size:w] - levels[: w - size]) + 2
        # a window that becomes full, or a new one, only leaves or enters a level
        change = np.append(change, 1 - 2 * levels[w - size])
        change[levels[: w - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * levels[size] + 1 if size < w else 0
        level = int(change.argmin())
        if level:
            stack = self.open[level]
            pieces = stack.pop()
            if not stack:
                del self.open[level]
            levels[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == w:
            yield pieces
        else:
            levels[level] += 1
            self.open.setdefault(level, []).append(pieces)

    def finish(self) -> Iterator[list[Piece]]:
        """The windows still open, joined into whole windows and powers of two."""
        rest = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        left = sum(len(p[2]) for p in rest)
        self.open.clear()
        self.levels[:] = 0
        pieces: list[Piece] = []
        room = target = self._next_target(left)
        for doc_id, start, ids, n in rest:
            at = 0
            while at < len(ids):
                part = ids[at : at + room]
                pieces.append((doc_id, start + at, part, n))
                at += len(part)
                room -= len(part)
                if not room:
                    yield pieces
                    left -= target
                    pieces = []
                    room = target = self._next_target(left)

    def _next_target(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(left, 1).bit_length() - 1


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )
    ddl = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        encoder, packer = word_tokenizer(tokenizer), LevelPacker(window)
        sequence = TaskContext.get().partitionId() << PARTITION_SHIFT
        end = np.array([END_ID], dtype="<u4")

        def columns(windows: Iterator[list[Piece]]) -> dict:
            nonlocal sequence
            out: dict[str, list] = {name: [] for name in schema.names}
            for pieces in windows:
                offset = 0
                for doc_id, start, ids, n in pieces:
                    values = doc_id, start, len(ids), ids.tobytes(), n, sequence, offset
                    for column, value in zip(out.values(), values):
                        column.append(value)
                    offset += len(ids)
                sequence += 1
            return out

        for batch in batches:
            for lo, hi in chunks(batch["text"], 2 << 20):
                ids = encoder.encode(batch["text"][lo:hi])
                # copies, since open windows would otherwise hold on to the whole batch
                whole = (np.concatenate([i, end]) for i in ids)
                yield columns(w for doc, i in zip(batch["doc_id"][lo:hi], whole) for w in packer.add(doc, i))
        yield columns(packer.finish())

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_rows(rows, run, schema, ddl)


def judged(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Contract columns per piece, with the checksum of its ids in their place."""
    pieces = packed(docs, tokenizer)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
