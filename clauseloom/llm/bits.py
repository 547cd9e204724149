"""Variable-length codes to bytes and back, over whole arrays at a time."""

from __future__ import annotations

import numpy as np


def pack(codes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, total_bits: int) -> np.ndarray:
    """Bytes that hold each code's low ``length`` bits, most significant first, at its bit offset.

    Offsets ascend and codes do not overlap; a code has at most 57 bits. Bits between codes are zero.
    """
    words = np.zeros(total_bits // 64 + 2, np.uint64)
    if len(codes):
        codes = codes.astype(np.uint64)
        at = offsets >> 6
        over = (offsets & 63) + lengths - 64
        inside = np.where(over <= 0, codes << np.maximum(-over, 0).astype(np.uint64), codes >> np.maximum(over, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[first]] = np.add.reduceat(inside, first)
        crossing = np.flatnonzero(over > 0)
        words[at[crossing] + 1] += codes[crossing] << (64 - over[crossing]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: (total_bits + 7) // 8]


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte position the 32 bits that start there; zeros follow the end."""
    b = np.concatenate([data, np.zeros(8, np.uint8)])
    out = b[:-3].astype(np.uint32)
    for n in (1, 2, 3):
        out <<= np.uint32(8)
        out |= b[n : len(b) - 3 + n]
    return out


def peek(window: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The next ``bits`` (25 at most) bits at each bit position, from :func:`windows`."""
    return (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - bits)
