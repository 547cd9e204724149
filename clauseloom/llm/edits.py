"""Edit distances of many pairs of short arrays at a time, up to a bound."""

from __future__ import annotations

import numpy as np

#: Pairs that go side by side.
SIDE = 2048


def within_edits(one: list[np.ndarray], two: list[np.ndarray], bound: int) -> np.ndarray:
    """Whether each pair of code point arrays has Levenshtein distance ``bound`` (31 at most) or less.

    Hyyrö's bit-parallel columns over the diagonal band of width ``2 * bound + 1``: a word per
    pair holds the vertical differences of the band, one step per character moves it down the diagonal.
    """
    out = np.zeros(len(one), bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(one, two)], np.int64).reshape(-1, 2)
    near = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= bound)
    short = near[sizes[near].min(axis=1) <= bound]
    for n in short.tolist():  # the band is as long as the word
        out[n] = _plain(one[n], two[n]) <= bound
    order = near[sizes[near].min(axis=1) > bound]
    order = order[np.argsort(sizes[order, 1], kind="stable")]
    for at in range(0, len(order), SIDE):
        chosen = order[at : at + SIDE]
        out[chosen] = _banded([one[n] for n in chosen], [two[n] for n in chosen], bound) <= bound
    return out


def _plain(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _banded(one: list[np.ndarray], two: list[np.ndarray], bound: int) -> np.ndarray:
    pairs = len(one)
    m, n = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    # rows of the pattern from ``bound`` places before its start to as many after its end
    pattern = np.full((int(max(m.max(), n.max())) + 2 * bound + 2, pairs), 0xFFFFFFFF, np.uint32)
    text = np.full((int(n.max()), pairs), 0xFFFFFFFE, np.uint32)
    for k, (a, b) in enumerate(zip(one, two)):
        pattern[bound : bound + len(a), k] = a
        text[: len(b), k] = b
    width = 2 * bound + 1
    top = np.uint64(63)
    bit = [np.uint64(1 << (64 - width + d)) for d in range(width)]
    plus = np.full(pairs, (((1 << (bound + 1)) - 1) << (63 - bound)), np.uint64)
    minus = np.zeros(pairs, np.uint64)
    distance = np.full(pairs, bound, np.int64)
    corner = m - bound  # columns after which the band's last row is the pattern's
    one64 = np.uint64(1)
    for j in range(int(n.max())):
        on = j < n
        equal = np.zeros(pairs, np.uint64)
        for d in range(width):
            equal |= np.where(pattern[j + d] == text[j], bit[d], np.uint64(0))
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(zero | plus)
        down = zero & plus
        slide = on & (j < corner)
        distance += slide & ((zero >> top) == 0)
        level = on & ~slide
        if level.any():
            at = (top - np.clip(j - corner + 1, 0, 63).astype(np.uint64))
            distance += level * ((up >> at & one64).astype(np.int64) - (down >> at & one64).astype(np.int64))
        shifted = zero >> one64
        plus = np.where(on, down | ~(shifted | up), plus)
        minus = np.where(on, shifted & up, minus)
    return distance
