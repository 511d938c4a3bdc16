"""Words and shingles of whole texts as 64-bit hashes, in numpy.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()``
splits UTF-8 at exactly these six bytes.  Texts may be null (no words).
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that mix the places of a window; any fixed odd numbers do.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; a bijection, so distinct values stay distinct."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


class WordHasher:
    """Hash words through a memo that is dropped when ``limit`` words are held."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.memo = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in memo:
                    memo[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` words, in order of place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out * _STEP + hashes[i : i + n])
    return out


def shingle_set(text: str | None, hasher: WordHasher, width: int = 5, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; the whole sequence if shorter; none without words.

    ``lower`` lower-cases A-Z only, as ``bytes.lower`` does.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hasher(words), min(width, len(words))))
