"""Bounded parts of frames inside tasks."""

import pandas as pd

from clauseloom.operators import frames as S


def test_slices_hold_every_row_once_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(S, "SLICE_CHARS", 10)
    frame = pd.DataFrame({"k": range(8), "t": ["abc", None, "x" * 25, "", "abcdef", "abcdef", "a", "b"]})
    parts = list(S.slices([frame, frame.iloc[:0]], "t"))
    sizes = [p["t"].fillna("").str.len() for p in parts if len(p)]
    assert [k for p in parts for k in p["k"]] == list(range(8)) and len(sizes) > 3
    assert all(n.sum() - n.max() < 10 for n in sizes)
