"""Embedders: texts to unit vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(ABC):
    dim: int

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """Unit vectors, float32, one row for each text."""

    def column(self, text_col: str) -> Column:
        """The embedding of a column, a batch at a time."""

        @F.arrow_udf("array<float>")
        def embedded(texts: pa.Array) -> pa.Array:
            rows = self.embed([t or "" for t in texts.to_pylist()])
            return pa.array([*rows], pa.list_(pa.float32()))

        return embedded(F.col(text_col))


class HashEmbedder(Embedder):
    """Signed counts of a text's character trigrams in hashed slots, at length one: texts that share trigrams are near.

    It stands in for a model. The hash of a trigram is a sum of its characters times odd constants, mixed by a shift and
    a product; the seed gives another space. A text is read between two marks, so that the empty one has a trigram, too.
    """

    def __init__(self, dim: int = 384, seed: int = 0):
        self.dim, self.seed = dim, seed
        self._odd = np.random.default_rng(seed).integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _vector(self, text: str) -> np.ndarray:
        c = np.frombuffer(f"\x02\x02{text}\x03".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = c[:-2] * self._odd[0] + c[1:-1] * self._odd[1] + c[2:] * self._odd[2]
        h = (h ^ h >> np.uint64(29)) * self._odd[3]
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        v = np.bincount((h >> np.uint64(20)) % np.uint64(self.dim), sign, self.dim)
        size = np.linalg.norm(v)
        if not size:  # the signs have cancelled each other
            v[0] = size = 1.0
        return (v / size).astype(np.float32)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([self._vector(t) for t in texts], np.float32).reshape(len(texts), self.dim)
