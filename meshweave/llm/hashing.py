"""Vectorised 64-bit hashes of byte strings and their substrings."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_24)
#: A random odd number for each byte value, and the base of the polynomial with its inverse modulo 2**64.
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_RANDOM.integers(1, 2**63)) | 5
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << (n + 1).bit_length()
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = pow(BASE, -1, 2**64)
        _inverses = np.cumprod(steps)


class Substrings:
    """Hashes of any substrings of one text, from prefix sums; equal substrings have equal hashes."""

    def __init__(self, data: bytes):
        _grow(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[np.frombuffer(data, np.uint8)] * _powers[: len(data)], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * _inverses[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes at each start."""
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * _inverses[:n]) if n > 0 else np.zeros(0, np.uint64)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width``-word shingles, A-Z folded; fewer words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    width = min(width, len(words))
    starts = np.concatenate([[0], gaps + 1])[: len(words) - width + 1]
    ends = np.append(gaps, len(joined))[width - 1 :]
    return np.unique(Substrings(joined).hashes(starts, ends))
