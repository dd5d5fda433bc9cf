"""Anchors: positions that equal stretches of bytes have in common.

Of the ``gram``-byte strings inside a window of ``length`` bytes the one with the least hash
anchors the window (the last of equal ones).  Equal windows are anchored at the same place
in them, so comparing the windows of equal anchors finds every repeated window, while only
about two positions in ``length - gram + 2`` are anchors.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 200, 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19
_LOW = (1 << 20) - 1


def _powers(x: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), x, np.uint64)]))[:n]


_UP, _DOWN = _powers(_BASE, _CHUNK + LENGTH), _powers(_INVERSE, _CHUNK + LENGTH)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any stretch of one text, by sums of powers."""

    def __init__(self, raw: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive keys, from running minima over blocks of ``w``."""
    n = len(key)
    padded = np.concatenate([key, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, hash, first, last, context): the anchors of a text, hashes of the grams there, the first and last window starts they anchor, and a hash of all bytes of those windows."""
    w, parts = length - gram + 1, []
    for at in range(0, max(1, len(text) - length + 1), _CHUNK):
        raw = np.frombuffer(text, np.uint8)[at : at + _CHUNK + length - 1]
        if len(raw) < length:
            break
        hasher = Hasher(raw)
        places = np.arange(len(raw) - gram + 1)
        h = hasher.of(places, places + gram)
        chosen = _LOW - (_least(h & ~np.uint64(_LOW) | (np.uint64(_LOW) - places.astype(np.uint64)), w) & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        place = chosen[first]
        # the same bytes with the anchor elsewhere in them are another context
        context = hasher.of(first, last + length) ^ _mixed((place - first).astype(np.uint64))
        parts.append((place + at, h[place], first + at, last + at, context))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
