"""Content-defined anchors of byte strings and hashes of any of their substrings."""

from __future__ import annotations

import numpy as np

from bazaarflow.llm.hashing import mix, powers

WINDOW = 8


class Substrings:
    """Hashes of substrings of data of at least WINDOW bytes, each in constant time."""

    def __init__(self, data: bytes) -> None:
        n = max(0, len(data) - WINDOW + 1)
        self.mixed = mix(np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))) if n else np.zeros(0, dtype=np.uint64)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.mixed * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - WINDOW + 1] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def segments(self, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first, last): positions p in first..last whose length-byte string has that anchor.

        The anchor of a string is its leftmost window of least hash among those that begin a gram inside the
        string, so equal strings have it at the same place. ends: where the documents of data end.
        """
        wide = length - gram + 1
        n = len(self.mixed) + WINDOW - length  # strings
        if n <= 0:
            return (np.zeros(0, dtype=np.int64),) * 3
        bits = np.uint64(int(len(self.mixed)).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        packed = (self.mixed & ~low) | np.arange(len(self.mixed), dtype=np.uint64)
        least = _sliding_least(packed, wide)[:n]
        anchor = (least & low).astype(np.int64)
        inside = np.zeros(n, dtype=bool)
        begins = np.concatenate(([0], ends[:-1]))
        for a, b in zip(begins.tolist(), (ends - length + 1).tolist()):
            inside[a : max(a, b)] = True
        at = np.flatnonzero(inside)
        if not len(at):
            return (np.zeros(0, dtype=np.int64),) * 3
        chosen = anchor[at]
        new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1))))
        return chosen[new], at[new], at[np.concatenate((new[1:], [len(at)])) - 1]


def _sliding_least(values: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of values[i : i + wide] for every i, by prefix and suffix minima of blocks."""
    blocks = -(-(len(values) + wide) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, wide)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    size = len(padded) - wide + 1
    return np.minimum(suffix[:size], prefix[wide - 1 : wide - 1 + size])
