"""Vectorised hashing and gathering of slices of a byte array."""

from __future__ import annotations

import numpy as np

from fieldcheck.llm.common import mixed

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hash_slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of raw: equal bytes, equal hash, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_windows(raw: np.ndarray, size: int) -> np.ndarray:
    """The hash of every stretch of `size` bytes, by its start; hash_slices gives the same."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
        return mixed((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def gather(source: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices number `which` of source, one behind the other, and the offsets that cut the result."""
    sizes = offsets[which + 1] - offsets[which]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(offsets[which] - cuts[:-1], sizes)
    return source[shift + np.arange(cuts[-1])], cuts


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D in each text: starts, ends, and the first word of each text.

    The third array has one more entry than there are texts: words of text i are first[i]:first[i + 1].
    """
    # A blank is put between texts by looking at the cut itself: a word ends where its text does.
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    begins[cut] = solid[cut]
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[inner > 0] - 1
    stops[inner] = solid[inner]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)
