"""Hashes of all words of a run of text at once.

A word's hash is a mixed polynomial of random 64-bit numbers of its bytes (A-Z as a-z), so
one pass of array operations hashes every word, and the beginnings of words are partial sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = bytes([32, *range(9, 14)])
_SEED = 41


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def table(marks: bytes) -> np.ndarray:
    """Which bytes are among ``marks``."""
    out = np.zeros(256, bool)
    out[list(marks)] = True
    return out


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(number of each byte, powers of a random odd base)."""
    rng = np.random.default_rng(_SEED)
    number = rng.integers(0, 1 << 64, 256, np.uint64)
    number[65:91] = number[97:123]
    base = rng.integers(0, 1 << 64, 1, np.uint64) | np.uint64(1)
    return number, np.cumprod(np.repeat(base, 1 << 12), dtype=np.uint64)


def word_hashes(raw: bytes, breaks: bytes = SPACE, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, length, [hash, hash of the first n bytes for each n of ``beginnings``]) of all
    words of ``raw``, which any byte of ``breaks`` ends. A word that is not longer than a
    beginning has its own hash there."""
    number, powers = letters()
    data = np.frombuffer(raw, np.uint8)
    inside = ~table(breaks)[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = ends - starts
    if not len(starts):
        return starts, length, [np.empty(0, np.uint64)] * (1 + len(beginnings))
    while len(powers) < length.max():
        powers = np.concatenate([powers, powers * powers[-1]])
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    values = number[data[inside]] * powers[place]
    full = mix64(np.add.reduceat(values, at) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = [full]
    for n in beginnings:
        part = mix64(np.add.reduceat(np.where(place < n, values, np.uint64(0)), at) + np.uint64(n))
        out.append(np.where(length > n, part, full))
    return starts, length, out
