"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import WordHashes, mix

SIZE = 5
_ODD = np.random.default_rng(20240602).integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, words: WordHashes) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a text, A-Z lower-cased; with fewer words,
    of the whole sequence; without words, none."""
    w = words.array((text or b"").lower().split())
    if not len(w):
        return w
    n = max(1, len(w) - SIZE + 1)
    total = np.full(n, min(len(w), SIZE), np.uint64)
    for k in range(min(len(w), SIZE)):
        total += w[k : k + n] * _ODD[k]
    return np.unique(mix(total))
