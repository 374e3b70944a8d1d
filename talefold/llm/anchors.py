"""Anchors: places of a byte string that any two copies of a long enough passage share.

Of the hashes of all K-byte runs that start in a window of SPAN bytes, the least
one marks the window's anchor (the leftmost of equals). A window's anchor depends
on its bytes alone, so equal windows have anchors at equal offsets. The hashes place
anchors and bring candidates together; what is equal is not decided by them.
"""

from __future__ import annotations

import functools

import numpy as np

from .shingles import STEP, mix

SPAN, K = 400, 64
CODE = mix(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (STEP, pow(STEP, -1, 1 << 64)):
        steps = np.full(1 << bits, m, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return tuple(out)


class Prefix:
    """Hashes of any runs of a byte string, in constant time each."""

    def __init__(self, b: np.ndarray):
        forth, self.back = _powers(max(16, (len(b) + 1).bit_length()))
        self.total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(CODE[b] * forth[: len(b)], out=self.total[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.back[start])


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


#: Windows looked at together; a place among them fits the low bits.
SLAB, LOW = 1 << 22, np.uint64((1 << 24) - 1)


def anchors(prefix: Prefix, n: int, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """at, key, first, last: each anchor, its hash, and the first and last start of a window it marks."""
    found = [np.zeros(0, np.int64)]
    w = span - k + 1
    for s in range(0, n - span + 1, SLAB):
        starts = np.arange(s, min(s + SLAB, n - span + 1) + w - 1)
        h = prefix.runs(starts, starts + k)
        # Places in the low bits break ties to the left and come out with the least.
        least = sliding_least((h & ~LOW) | (starts - s).astype(np.uint64), w)
        found.append(s + (least & LOW).astype(np.int64))
    at = np.concatenate(found)
    if not len(at):
        return at, at.astype(np.uint64), at, at
    edge = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]]) - 1
    at = at[first]
    return at, prefix.runs(at, at + k), first, last
