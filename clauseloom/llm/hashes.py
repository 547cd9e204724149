"""Hashes of runs of bytes and of code points."""

from __future__ import annotations

import numpy as np
import xxhash

from .batches import mix

#: Longer pieces are hashed one by one.
LANES = 6
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_CHAINS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(29)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two numbers, for every piece ``data[start:end]``; the same wherever it stands.

    Pieces are read eight bytes at a time, side by side; each step multiplies and shifts, so that no
    two pieces of one length that differ in the last step alone collide, and no structure of the
    text carries through. Long pieces are hashed by xxh3.
    """
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    out = [mix(sizes.astype(np.uint64), 31 + 2 * seed), mix(sizes.astype(np.uint64), 32 + 2 * seed)]
    on = np.flatnonzero((sizes > 0) & (sizes <= 8 * LANES))
    state = [h[on] for h in out]
    at, left = starts[on], sizes[on]
    while len(on):
        lane = lanes[at] & _MASKS[np.minimum(left, 8)]
        for k, (factor, shift) in enumerate(_CHAINS):
            h = (state[k] ^ lane) * factor
            state[k] = h ^ h >> shift
        more = left > 8
        if not more.all():
            done = ~more
            for k in (0, 1):
                out[k][on[done]] = state[k][done]
            on, at, left = on[more], at[more], left[more]
            state = [h[more] for h in state]
        at, left = at + 8, left - 8
    view = memoryview(np.ascontiguousarray(data))
    low = (1 << 64) - 1
    for n in np.flatnonzero(sizes > 8 * LANES).tolist():
        whole = xxhash.xxh3_128_intdigest(view[starts[n] : ends[n]], seed)
        out[0][n], out[1][n] = whole & low, whole >> 64
    return mix(out[0]), mix(out[1])


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Each item's number among the distinct ``one``, where each of them comes first, and whether some items agree in ``one`` but not in ``two``."""
    _, first, code = np.unique(one, return_index=True, return_inverse=True)
    return code, first, bool((two[first][code] != two).any())


class RollingSums:
    """A 64-bit value of any run of an array, alike for like runs, from running sums.

    Unlike runs may share one (some do whatever the base), so it serves to propose candidates only.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, data: np.ndarray):
        # an odd base has an inverse, so a run's sum can be moved to the origin
        both = []
        for base in (self._BASE, pow(self._BASE, -1, 1 << 64)):
            row = np.full(len(data) + 1, base, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row))
        self._back = both[1]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * both[0][:-1], out=self._sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts])
