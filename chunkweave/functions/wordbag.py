"""A deterministic stand-in for an embedding service: hashed bag of words, L2-normalised.

It lets whole builds and searches run and be checked without a model; it says nothing about
embedding quality. Real jobs pass their own ``Embedder``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np

Embedder = Callable[[Sequence[str]], np.ndarray]


@lru_cache(maxsize=1 << 15)
def _slot(word: str) -> int:
    return int(md5(word.encode("utf-8")).hexdigest()[:4], 16)


def word_bag(dim: int = 32) -> Embedder:
    """Embedder of ``dim`` dimensions: lower-cased words counted in hashed slots."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for row, text in enumerate(texts):
            slots = [_slot(word) % dim for word in text.lower().split()]
            if slots:
                out[row] = np.bincount(slots, minlength=dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)

    return embed
