"""Sets of hashed word shingles and their sketches."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WORDS = 5  # words of a shingle
TOKENS = 128  # positions of a sketch


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a finaliser of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        return mix(start + np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))


_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_byte = drawn(1, 256)
_byte[_white] = 0
_base = int(drawn(2, 1)[0]) | 1
_inverse = pow(_base, -1, 1 << 64)
_place = drawn(3, WORDS) | np.uint64(1)
_scale = drawn(4, TOKENS) | np.uint64(1)
_shift = drawn(5, TOKENS)
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_base, _inverse)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype="u8")
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word, in order; words are parted by white space."""
    raw = np.frombuffer(text.encode(), "u1")
    dark = ~_white[raw]
    starts = np.flatnonzero(dark & ~np.concatenate([[False], dark[:-1]]))
    if not len(starts):
        return np.zeros(0, "u8")
    ends = np.flatnonzero(dark & ~np.concatenate([dark[1:], [False]])) + 1
    up, down = _tables(len(raw))
    sums = np.add.reduceat(_byte[raw] * up[: len(raw)], starts)
    return mix(sums * down[starts] + (ends - starts).astype("u8"))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``WORDS`` words of the whole text.

    A text of fewer words is one shingle; one without words has none.
    """
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, min(len(words), WORDS), "u8")
    for k in range(min(WORDS, len(words))):
        total = total + words[k : k + n] * _place[k]
    return np.unique(mix(total))


def set_name(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minimum under ``TOKENS`` hash functions: two sets agree at a position as often as their
    Jaccard similarity says."""
    least = np.full(TOKENS, np.iinfo("u8").max, "u8")
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _scale + _shift
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")
