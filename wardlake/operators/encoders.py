"""Encoders that load a model from files: once per Python worker, and then for whole Arrow batches.

The model's files travel with the job (``SparkContext.addFile``) and are found on every executor; ``load`` turns their
paths into a function from a list of texts to a matrix with one row per text. The column made here goes wherever an
encoder is taken (``retrieval.embed_with``).
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Texts encoded at once.
BATCH_TEXTS = 256

Encode = Callable[[Sequence[str]], np.ndarray]
# Where a worker keeps its models: functions of this package are sent with each job, so its own globals would not last.
KEPT = "_models_of_this_worker"


def _model(load: Callable[[list[str]], Encode], names: Sequence[str]) -> Encode:
    loaded = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    key = repr((load.__module__, load.__qualname__, *names))
    if key not in loaded:
        loaded[key] = load([SparkFiles.get(n) for n in names])
    return loaded[key]


def model_encoder(spark: SparkSession, files: Sequence[str], load: Callable[[list[str]], Encode], text: str = "text") -> Column:
    """Unit vectors of ``text`` as ``array<float>``; null for null texts and for texts that the model gives no direction.

    ``files`` are paths that the driver can read, local or in the shared store; their base names must differ, and a name
    stands for the same file as long as the session lives.
    """
    names = [os.path.basename(f) for f in files]
    if len(set(names)) < len(names):
        raise ValueError("two model files have one name")
    for f in files:
        spark.sparkContext.addFile(f)

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _model(load, names)
        for batch in batches:
            known = batch.dropna()
            out: dict = {}
            for at in range(0, len(known), BATCH_TEXTS):
                part = known.iloc[at : at + BATCH_TEXTS]
                matrix = np.asarray(encode(part.tolist()), dtype=np.float64)
                sizes = np.sqrt((matrix * matrix).sum(axis=1))
                for row, vector, size in zip(part.index, matrix, sizes):
                    out[row] = (vector / size).astype(np.float32) if size > 0 else None
            yield pd.Series([out.get(i) for i in batch.index], dtype=object)

    return encoded(F.col(text))


def load_trigram_model(files: list[str]) -> Encode:
    """A small deterministic encoder: hashed letter trigrams of a text times the stored matrix (buckets x dimensions)."""
    (path,) = files
    weights = np.load(path)

    def encode(texts: Sequence[str]) -> np.ndarray:
        counts = np.zeros((len(texts), len(weights)))
        for row, text in enumerate(texts):
            low = f" {text.lower()} "
            for i in range(len(low) - 2):
                counts[row, zlib.crc32(low[i : i + 3].encode()) % len(weights)] += 1
        return np.sqrt(counts) @ weights

    return encode


def save_trigram_model(path: str, buckets: int = 2048, dim: int = 64, seed: int = 1) -> str:
    """Random directions for the trigram encoder, the same for the same arguments."""
    np.save(path, np.random.default_rng(seed).normal(size=(buckets, dim)))
    return path
