"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed together.
CHUNK = 1 << 21
MULTIPLIER = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 18))
        _POWERS.clear()
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, one after the other, and the number of words of each text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _IS_SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    lengths = np.array([len(t) for t in texts])
    stops = np.cumsum(lengths + 1)
    counts = np.diff(np.searchsorted(begin, stops), prepend=0)
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    up, down = _powers(len(data))
    value = np.where(space, 0, data.astype(np.uint64) + 1) * up[: len(data)]
    return mix(np.add.reduceat(value, begin) * down[begin]), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; those that cross from one text to the next are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(MULTIPLIER | 1)
        out += words[j : j + n]
    return mix(out)


def chunks(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes each; a longer text is a range of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    return [*out, (start, len(texts))] if len(texts) > start else out
