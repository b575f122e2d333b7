"""Arrow-batched chunk splitter; local to one document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk limits in characters and the separators, coarse to fine.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
MIN_CHUNK = 100
SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_text(text: str, size: int = CHUNK_SIZE, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pack text greedily into pieces of at most ``size``, cutting at the coarsest separator that works.

    Works off an explicit stack of ``(text, depth)``; a part that is still too long at one separator
    is pushed back with the next finer one.
    """
    done: list[str] = []
    todo = [(text, 0)]
    while todo:
        current, depth = todo.pop()
        if len(current) <= size:
            done.append(current)
            continue
        if depth == len(separators):
            done.extend(current[at : at + size] for at in range(0, len(current), size))
            continue
        glue = separators[depth]
        packed: list[tuple[str, int]] = []
        group: list[str] = []
        length = 0
        for part in current.split(glue):
            grown = length + len(glue) + len(part) if length else len(part)
            if grown <= size:
                if not length:  # an empty running piece takes the part over without a separator
                    group = []
                group.append(part)
                length = grown
                continue
            if length:
                packed.append((glue.join(group), depth))
            if len(part) > size:
                packed.append((part, depth + 1))
                group, length = [], 0
            else:
                group, length = [part], len(part)
        if length:
            packed.append((glue.join(group), depth))
        todo.extend(reversed(packed))
    return done


def chunk_text(text: str) -> list[str]:
    """Split, prefix each piece with the tail of the one before it, trim, drop what is too short."""
    pieces = split_text(text)
    tails = ["", *[piece[-CHUNK_OVERLAP:] + " " for piece in pieces[:-1]]]
    trimmed = ((tail + piece).strip() for tail, piece in zip(tails, pieces))
    return [chunk for chunk in trimmed if len(chunk) >= MIN_CHUNK]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunk_text(t) if t is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_text(t) if t is not None else [])
