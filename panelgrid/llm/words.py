"""Hashes of words and word runs, vectorised over one text.

A text is UTF-8; its words are what ``bytes.split()`` gives, the runs of bytes other than
space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(41)
_ODD = np.uint64(1)
#: One random number for each byte value; the space between words counts nothing.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_VALUES[32] = 0
#: Powers of an odd base; words longer than the table use it cyclically.
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
#: Odd factors for the words of a run, the same for any run length up to 256.
PLACES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _ODD


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash for each word; empty for null and for text without words."""
    return hashes_of(text.split() if text else [])


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each of the words, none of which is empty or holds white space."""
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.zeros(len(spaces) + 1, np.int64)
    starts[1:] = spaces + 1
    lengths = np.empty(len(starts), np.int64)
    lengths[:-1] = starts[1:] - starts[:-1]
    lengths[-1] = len(data) - starts[-1]
    offsets = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(BYTE_VALUES[data] * POWERS[offsets & 4095], starts))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for each run of ``length`` consecutive words; none if there are fewer."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total += words[k : k + n] * PLACES[k]
    return mix(total)


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct run hashes; a shorter text is one run, an empty one has none."""
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(length, len(words))))
