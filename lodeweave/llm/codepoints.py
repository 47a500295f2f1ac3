"""Texts of a batch as one array of code points, so that classes, runs and hashes are computed for all of them at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(1)
def lowered() -> np.ndarray:
    """Every code point in lower case (the first one, where there are several), so that offsets stay those of the text."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        out[c] = ord(chr(c).lower()[0])
    return out


@lru_cache(1)
def _mixed() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, _BASE_INV, np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
    return _powers[0], _powers[1]


def buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (with the end as last entry)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of points[start:end] for each run; equal runs have equal hashes wherever they stand."""
    p, q = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed()[points] * p[: len(points)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``limit`` characters together; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_runs(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters or digits within texts."""
    inside = (classes()[points] & 3) % 3 != 0  # LETTER or NUMBER
    edge = np.zeros(len(points) + 1, bool)
    edge[:-1] = inside
    edge[1:] ^= inside
    first = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(points))]
    glued = np.unique(first[inside[first] & inside[first - 1]])
    both = np.sort(np.concatenate([np.flatnonzero(edge), glued, glued]))
    return both[0::2], both[1::2]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the texts: a run of letters or digits, lower-cased."""
    points, at = buffer([t.lower() if t else "" for t in texts])
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = word_runs(points, at)
    return np.searchsorted(at, starts, "right") - 1, run_hashes(points, starts, ends)
