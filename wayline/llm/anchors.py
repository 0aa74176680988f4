"""Anchors: places of a text that every copy of a passage has too.

Of all the GRAM-byte strings inside a MATCH-byte window, those with the least hash are anchors. Two equal windows have
anchors at the same offsets, so windows need to be compared only where anchors have the same string.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Length of a match and of the strings hashed inside it, in bytes.
MATCH, GRAM = 100, 32
#: Starts of windows that hold a given gram: it and this many before it.
REACH = MATCH - GRAM
#: Longest part of a text that is hashed at once.
PART = 1 << 19

_BYTES = np.random.default_rng(11).integers(0, 2**64, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # an odd multiplier


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = PART + 4 * MATCH
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of() over each window of `width` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of the gram there) of a text's anchors."""
    if len(text) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = []
    for first in range(0, len(text) - MATCH + 1, PART):
        low = max(0, first - MATCH)
        parts.append(_in_part(text, low, first, min(first + PART, len(text) - MATCH + 1)))
    if len(parts) == 1:
        return parts[0]
    at = np.concatenate([p[0] for p in parts])
    at, once = np.unique(at, return_index=True)
    return at, np.concatenate([p[1] for p in parts])[once]


def _in_part(text: bytes, low: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that start in [first, end); bytes from `low` on are hashed."""
    up, down = _powers()
    raw = np.frombuffer(text, np.uint8, count=min(len(text), end + 2 * MATCH) - low, offset=low)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        starts = slice(first - low, end - low + REACH)
        grams = _mixed((sums[starts.start + GRAM : starts.stop + GRAM] - sums[starts]) * down[starts])
        order = (grams >> np.uint64(32)).astype(np.uint32)
        least = _sliding(order, REACH + 1, np.minimum)
        padded = np.zeros(len(least) + 2 * REACH, np.uint32)
        padded[REACH : REACH + len(least)] = least
        chosen = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == order)
    return chosen + first, grams[chosen]
