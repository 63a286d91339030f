"""CRC-32 of many runs of bytes at once, and of runs that are joined: no Python object per run is made."""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Bytes of a run that are taken in steps over all runs; zlib takes the rest of longer ones.
STEPS = 64
DIGIT = 64


def _table() -> np.ndarray:
    """The byte table of the polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = _table()


def of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each run of bytes; before: the CRC of what stands before it."""
    n = ends - starts
    c = np.full(len(n), 0xFFFFFFFF, np.uint32) if before is None else ~before.astype(np.uint32)
    live = np.arange(len(n))
    for j in range(min(int(n.max(initial=0)), STEPS)):
        live = live[n[live] > j]
        was = c[live]
        c[live] = TABLE[(was ^ data[starts[live] + j]) & 0xFF] ^ was >> 8
    c = ~c
    for i in np.flatnonzero(n > STEPS):
        c[i] = zlib.crc32(data[starts[i] + STEPS : ends[i]].tobytes(), int(c[i]))
    return c


def _through(tables: np.ndarray, at: np.ndarray | int, c: np.ndarray) -> np.ndarray:
    """c through the four byte tables that begin at ``at`` in ``tables``."""
    out = tables[at + (c & 0xFF)]
    for place in (1, 2, 3):
        out ^= tables[at + 256 * place + (c >> np.uint32(8 * place) & 0xFF)]
    return out


@functools.lru_cache(maxsize=8)
def _zeros(digit: int) -> np.ndarray:
    """Byte tables that carry a CRC over n * 64 ** digit zero bytes, for each n below 64, end to end."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    out = [c]
    for _ in range(DIGIT - 1):
        c = out[-1]
        if digit:
            c = _through(_zeros(digit - 1), 1024 * (DIGIT - 1), c)
            out.append(_through(_zeros(digit - 1), 1024, c))
        else:
            out.append(TABLE[c & 0xFF] ^ c >> 8)
    return np.concatenate(out)


def joined(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of each left and right run on end. n: bytes of the right one."""
    out = _through(_zeros(0), n % DIGIT * 1024, left)
    n, digit = n // DIGIT, 1
    while n.any():
        at = np.flatnonzero(n)
        out[at] = _through(_zeros(digit), n[at] % DIGIT * 1024, out[at])
        n, digit = n // DIGIT, digit + 1
    return out ^ right
