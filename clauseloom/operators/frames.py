"""Frames inside tasks, a bounded part at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd

#: Characters of texts that a task works on at a time.
SLICE_CHARS = 1 << 20


def slices(frames: Iterable[pd.DataFrame], column: str, size: Callable = len) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about ``SLICE_CHARS`` of ``column``, one at least, so that what a task makes of texts does not pile up. Freed memory goes back at the end."""
    for frame in frames:
        sizes = np.fromiter((0 if x is None else size(x) for x in frame[column]), np.int64, len(frame))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CHARS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            yield frame.iloc[a:b]
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
