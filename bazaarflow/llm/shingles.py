"""Word shingles of a text as a sorted array of different 64-bit hashes."""

from __future__ import annotations

import numpy as np

from bazaarflow.llm.hashing import hash_runs, mix

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased; words are what space, tab, LF, VT, FF and CR separate."""
    data = np.frombuffer((text or "").encode().translate(_LOWER), dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACES[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return hash_runs(data, edges[0::2], edges[1::2])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the different runs of width words; a shorter text is one run, one without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * _ODD[i % 64]
    found = mix(total ^ np.uint64(width))
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
