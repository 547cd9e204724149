"""Many names at once against a loop over patterns, one name at a time."""

import random
import re
import time

from clauseloom.functions.names import NameFinder
from clauseloom.operators import statutes as L


def pattern(name):
    return re.compile(r"\s*".join("[ㆍ·・]" if c == "ㆍ" else re.escape(c) for c in name))


def plain_places(names, text):
    return [(n, *m.span()) for n, name in enumerate(names) if name for m in pattern(name).finditer(text)]


def plain_longest_first(names, text):
    taken, out = [], []
    for n in sorted(range(len(names)), key=lambda n: -len(names[n])):
        for m in pattern(names[n]).finditer(text) if names[n] else ():
            if not any(a <= m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((n, *m.span()))
    return out


def test_places_equal_a_loop_over_patterns():
    rng = random.Random(4)
    for _ in range(400):
        names = ["".join(rng.choices("abㆍ·법", k=rng.randrange(5))) for _ in range(rng.randrange(9))]
        text = "".join(rng.choices(["a", "b", "ㆍ", "·", "・", "법", " ", "\n", "\u3000"], k=rng.randrange(40)))
        finder = NameFinder(names)
        assert list(finder.places(text)) == plain_places(names, text)
        assert list(finder.longest_first(text)) == plain_longest_first(names, text)


def test_time_does_not_grow_with_the_number_of_names():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(20_000))
    some = ["".join(rng.choices("ghijkl", k=9)) for _ in range(40_000)] + ["abcdefab"]
    few, many = NameFinder(some[-100:]), NameFinder(some)
    took = []
    for finder in (few, many, few, many):
        start = time.perf_counter()
        found = list(finder.places(text))
        took.append(time.perf_counter() - start)
        assert found == plain_places(some[-1:], text) or [f[1:] for f in found] == [f[1:] for f in plain_places(some[-1:], text)]
    assert min(took[1], took[3]) < 5 * min(took[0], took[2]) + 0.05


def test_names_of_a_table(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "민 법과 상법, 민법"), (2, None), (3, ""), (1, "소비자 기본법")], "k int, t string")
    for most in (200_000, 2):
        monkeypatch.setattr(L, "NAMES", most)
        found = sorted(tuple(r) for r in L.find_names(rows, "k", "t", ["민법", "상법", "기본법", "민법", "소비자기본법"]).collect())
        assert found == [(1, "기본법", 4, 7), (1, "민법", 0, 3), (1, "민법", 9, 11), (1, "상법", 5, 7), (1, "소비자기본법", 0, 7)]
    monkeypatch.setattr(L, "NAMES", 200_000)
    assert sorted(r.name for r in L.find_names(rows, "k", "t", ["기본법", "소비자기본법"], longest_first=True).collect()) == ["소비자기본법"]
    assert L.find_names(rows, "k", "t", []).count() == 0
