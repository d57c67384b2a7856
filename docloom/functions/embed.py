"""Embeddings: a deterministic stand-in by hashed words, and the place to plug a model in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS = 384


def hashed_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector of signed word hashes; the zero vector for a text without words."""
    out = np.zeros(dimensions)
    for word in text.lower().split():
        code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[code % dimensions] += 1.0 if code >> 63 else -1.0
    return out / max(float(np.linalg.norm(out)), 1e-10)


def embedder(encode: Callable[[list[str]], np.ndarray] | None = None, batch: int = 32):
    """An Arrow function text -> array<float>; encode(texts) gives one row per text and is called in batches."""

    @arrow_udf(ArrayType(FloatType()))
    def embed(text: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        if encode is None:
            rows = [hashed_vector(t) for t in texts]
        else:
            rows = [r for at in range(0, len(texts), batch) for r in np.asarray(encode(texts[at : at + batch]))]
        return pa.array([np.asarray(r, np.float32) for r in rows], pa.list_(pa.float32()))

    return embed
