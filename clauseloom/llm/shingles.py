"""Sets of hashed word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .batches import mix, utf8
from .hashes import piece_hashes

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word ends at white space and where its text ends."""
    word = ~SPACE[data]
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text on end, ascending within a text, and how many each has.

    Words are maximal runs without ASCII white space, A-Z in lower case. A text with fewer than
    ``width`` words, one at least, has its whole sequence as only shingle.
    """
    data, bounds = utf8(texts)
    data = _LOWER[data]
    starts, ends = word_bounds(data, bounds)
    words = piece_hashes(data, starts, ends)[0]
    upto = np.searchsorted(starts, bounds)
    counts = np.diff(upto)
    rolling = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolling = mix(rolling ^ words[k : len(words) - width + 1 + k], k)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for n, (a, b) in enumerate(zip(upto.tolist(), upto[1:].tolist())):
        if b - a >= width:
            own = np.unique(rolling[a : b - width + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mix(whole ^ words[k : k + 1], k - a)
            own = mix(whole, b - a)
        else:
            continue
        sizes[n] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
