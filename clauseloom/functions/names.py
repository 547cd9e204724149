"""Many names looked up at once in texts that may space them differently."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick

# Middle dots that stand for one another where a name has the first.
DOTS = "ㆍ·・"
_ONE_DOT = str.maketrans({c: DOTS[0] for c in DOTS})


class NameFinder:
    """Places of names, which are written without spaces, in a text that may have white space between any of their characters.

    One automaton goes over the text's other characters once, however many names there are, and each place is led back to the text. A name's
    first kind of middle dot stands for any of them; all other characters stand for themselves.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.automaton = ahocorasick.Automaton()
        alike: dict[str, list[int]] = {}
        for n, name in enumerate(names):
            if name:
                alike.setdefault(name.translate(_ONE_DOT), []).append(n)
        for word, numbers in alike.items():
            self.automaton.add_word(word, (len(word), numbers))
        if alike:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(name's number, start, end) of all places, those of a name from left to right without overlap, names in their order."""
        at = [n for n, c in enumerate(text) if not c.isspace()]
        if not at or not len(self.automaton):
            return
        solid = "".join(text[n] for n in at)
        found: dict[int, list[int]] = {}
        for last, (size, numbers) in self.automaton.iter(solid.translate(_ONE_DOT)):
            first = last + 1 - size
            for n in numbers:
                if all(a == b or a == DOTS[0] for a, b in zip(self.names[n], solid[first : last + 1])):
                    found.setdefault(n, []).append(first)
        for n in sorted(found):
            size, free = len(self.names[n]), 0
            for first in found[n]:
                if first >= free:
                    free = first + size
                    yield n, at[first], at[free - 1] + 1

    def longest_first(self, text: str) -> Iterator[tuple[int, int, int]]:
        """As :meth:`places`, names of most characters first (as given, of equal ones), without places that start inside one that was taken."""
        taken = bytearray(len(text))
        for n, start, end in sorted(self.places(text), key=lambda p: (-len(self.names[p[0]]), p[0], p[1])):
            if not taken[start]:
                taken[start:end] = b"\1" * (end - start)
                yield n, start, end
