"""Text encoders. The default is deterministic and local: hashed words, normalised."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Encoder(Protocol):
    """What turns a batch of texts into an array of vectors; made once in each worker."""

    dim: int

    def encode(self, texts: list[str], batch_size: int) -> np.ndarray: ...


class HashingEncoder:
    """Counts of words and word pairs hashed into `dim` signed places."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def encode(self, texts: list[str], batch_size: int = 64) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            words = (text or "").lower().split()
            for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = xxhash.xxh3_64_intdigest(term)
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out


def encode(text: Column, encoder: Encoder, batch_size: int = 64, normalize: bool = True) -> Column:
    """The vector of each text. normalize gives unit length; a text without words has a zero vector."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = encoder.encode(s.fillna("").tolist(), batch_size)
            if normalize and len(v):
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(n > 0, n, 1)
            yield pd.Series(list(v.astype(np.float32)))

    return run(text)


def embed(chunks: DataFrame, encoder: Encoder, text: str = "text", batch_size: int = 64) -> DataFrame:
    """chunks with embedding and embedding_dim."""
    return chunks.withColumn("embedding", encode(F.col(text), encoder, batch_size)).withColumn("embedding_dim", F.lit(encoder.dim))
