"""Vectorised 64-bit hashes of the words of a text and of its word n-grams (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, PIECE + 1)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= PIECE + 1:
            _powers[base] = known
    return known[:n]


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_UNBASE, len(data) + 1)[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word (run without ASCII white space), in order. Long texts go in pieces that end
    between words."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= PIECE:
        return _piece_hashes(data)
    found, start = [], 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        if end < len(data):
            back = np.flatnonzero(SPACE[data[start:end]])
            if len(back):
                end = start + int(back[-1]) + 1
            else:  # a word longer than a piece
                step = end
                while step < len(data) and not SPACE[data[step : step + PIECE]].any():
                    step += PIECE
                end = len(data) if step >= len(data) else step + int(np.argmax(SPACE[data[step : step + PIECE]])) + 1
        found.append(_piece_hashes(data[start:end]))
        start = end
    return np.concatenate(found)


def ngram_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words. A text of 1 to n-1 words has one, of all its
    words; a text without words has none."""
    words = word_hashes(text)
    if len(words) == 0:
        return words
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * _PLACE[i]
    return np.unique(mix(total + np.uint64(width)))


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
