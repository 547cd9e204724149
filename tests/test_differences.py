"""Differences against difflib's own, and without its search where the common start decides."""

import difflib
import random

from clauseloom.operators import views as W


def test_opcodes_are_those_of_difflib():
    rng = random.Random(3)
    for n in range(20_000):
        one = rng.choices("ab c"[: rng.randrange(1, 5)], k=rng.randrange(9))
        two = [*one[: rng.randrange(len(one) + 1)], *rng.choices("abcd "[: rng.randrange(1, 6)], k=rng.randrange(6))] if n % 4 else rng.choices("abc", k=rng.randrange(9))
        for x, y in ((one, two), (two, one)):
            assert W.opcodes(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes(), (x, y)


def test_a_common_start_needs_no_search(monkeypatch):
    monkeypatch.setattr(W.difflib, "SequenceMatcher", None)
    assert W.difference("one two", "one two") == [("eq", "one two")]
    assert W.difference("one two", "one two (rev)") == [("eq", "one two"), ("ins", " (rev)")]
    assert W.difference("one two (rev)", "one two") == [("eq", "one two"), ("del", " (rev)")]
