"""Quartile bucket digests: short fingerprints of bytes whose difference follows the difference of the texts.

Every three consecutive bytes are hashed into one of 256 buckets and counted. A bucket's two-bit code says between
which quartiles of the 256 counts its count lies. The digest is the bytes' length on a logarithmic scale, the two
lower quartiles relative to the upper one, and the 256 codes, in hexadecimal.

The difference of two digests adds the distance of all codes (a jump over all quartiles weighs double) and that of
length and quartile ratios, and is bounded by ``MAX_DIFFERENCE``; likeness is 1 for equal digests and 0 at the bound.

Defined results: null counts as empty; bytes without triplets have all codes 0; a text alone in its table is its own
neighbour; repeated ids are ordered by text, null ids come first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.ranges import Blocks
from wardlake.llm.words import CHUNK_BYTES, arrow_rows
from wardlake.session import materialize

BUCKETS = 256
MAX_DIFFERENCE = 400
# UTF-8 bytes of text that one block of neighbouring documents holds.
BLOCK_BYTES = 4 << 20
# Bytes of a text that place it among rows of one id.
TIE_BYTES = 7

_CODE_COST = np.array([0, 1, 2, 6], dtype=np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets fall into each bucket; long inputs are counted piece by piece."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), CHUNK_BYTES):
        b = np.frombuffer(data[at : at + CHUNK_BYTES + 2], dtype=np.uint8).astype(np.uint32)
        if len(b) < 3:
            break
        h = b[:-2] * np.uint32(0x9E3779B1)
        h += b[1:-1] * np.uint32(0x85EBCA77)
        h += b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = [16 * q // max(q3, 1) & 15 if q < q3 else 15 for q in (q1, q2)]
    return f"{size:02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def _codes(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), dtype=np.uint8)
    return np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6])


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``MAX_DIFFERENCE``."""
    if a == b:
        return 0
    gap = np.abs(_codes(a).astype(np.int8) - _codes(b).astype(np.int8))
    total = int(_CODE_COST[gap].sum())
    total += abs(int(a[:2], 16) - int(b[:2], 16))
    total += sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))
    return min(MAX_DIFFERENCE, total)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every text, without a shuffle."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "fingerprint": [digest(t or b"") for t in batch["text"]]}

    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_rows(rows, run, schema, "doc_id bigint, fingerprint string")


def edited_with_next(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def against_neighbours(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, compared with each other and with the next document's.

    Documents are put into blocks of neighbouring ids, and of texts where one id has more than a block; the first document
    of each block also goes, marked, to the block before it (that of the first block to the last), so that every block is
    finished by itself in one pass over its sorted rows, holding two rows at a time.
    """
    # ids and, among equal ids, the first bytes of the text, in its order
    head = F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, TIE_BYTES)), 2 * TIE_BYTES, "0")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.conv(head, 16, 10).cast("bigint").alias("tie")
    )
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)).alias("weight")
    sizes = materialize(rows.select("doc_id", "tie", weight), "digest-sizes")
    blocks = Blocks.of(sizes, "doc_id", "tie", F.col("weight"), block_bytes)
    placed = blocks.add(rows, "doc_id", "tie")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("block_before").alias("block"), F.lit(True).alias("guest"))
    places = F.when(F.col("leads"), F.array(own, guest)).otherwise(F.array(own))
    dealt = blocks.deal(placed.select(F.inline(places), "doc_id", "text")).sortWithinPartitions("guest", "doc_id", "text")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        held = None  # the row that waits for the next one of its block
        for batch in batches:
            out: list[tuple] = []
            for block, is_guest, doc, raw in zip(batch["block"], batch["guest"], batch["doc_id"], batch["text"]):
                if held is not None and held[0] == block:
                    text, print_ = (raw or b"").decode(), digest(raw or b"")
                    edited = edited_with_next(held[2], text).encode()
                    edited_print = digest(edited)
                    near = likeness(held[3], edited_print), likeness(held[3], print_)
                    sha = hashlib.sha256(edited).hexdigest()
                    out.append((held[1], len(held[2]), sha, held[3], edited_print, *near))
                    held = None if is_guest else (block, doc, text, print_)
                elif not is_guest:
                    held = (block, doc, (raw or b"").decode(), digest(raw or b""))
            columns = list(zip(*out)) or [()] * len(schema)
            yield dict(zip(schema.names, map(list, columns)))

    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )
    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_rows(dealt, run, schema, ddl)
