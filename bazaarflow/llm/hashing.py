"""Array hashing shared by the operators; every function is a pure function of its content."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_X = np.uint64(0x9E3779B97F4A7C15)
_X_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of an odd number and of its inverse, modulo 2^64; at least n of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        steps = [np.full((n >> 16) + 1 << 16, x) for x in (_X, _X_INVERSE)]
        for s in steps:
            s[0] = 1
        _POWERS[:] = [np.multiply.accumulate(s) for s in steps]
    return _POWERS[0], _POWERS[1]


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[starts[i]:ends[i]], by differences of prefix sums."""
    spread = _BYTES[values] if values.dtype == np.uint8 else mix(values.astype(np.uint64) + np.uint64(1))
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(spread * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
