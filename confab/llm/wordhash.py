"""Vectorised words and word hashes over UTF-8 bytes: no Python object per word is made."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
RADIX = U(0x9E3779B97F4A7C15)
UNRADIX = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Multiplier that joins the hashes of neighbouring words.
LINK = U(0xD1B54A32D192ED03)
NONE = U(0xFFFFFFFFFFFFFFFF)


def byte_table(is_word) -> np.ndarray:
    """For each byte the lower-cased byte, or 0 where it is no part of a word."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if is_word(low):
            out[b] = low or 0xFF  # NUL keeps out of the way of the separator; 0xFF is no byte of UTF-8
    return out


#: Letters a-z, digits and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Everything but blank and the control characters 9 to 13.
NONBLANK = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, RADIX), np.full(n, UNRADIX)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(12, (max(n, 1) - 1).bit_length()))
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, first byte and end of each word, and the index of each text's first word (one entry more than texts)."""
    low = table[data]
    n = len(low)
    inside = low != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by a polynomial whose prefix sums serve all words at once."""
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, U)
    np.cumsum(low * up, dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hash of each k consecutive words; shorter than ``words`` by k - 1 entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n].copy()
    for i in range(1, k):
        out *= LINK
        out += words[i : i + n]
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
