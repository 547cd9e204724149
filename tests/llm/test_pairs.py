"""Operators on pairs against brute force: shingle sets, lines and vectors."""

import random
import re
import subprocess
import sys
from itertools import combinations

import numpy as np
import pytest

from clauseloom.llm.edits import within_edits
from clauseloom.llm.lines import count_repeated_lines, drop_repeated_lines
from clauseloom.llm.partenum import jaccard_groups, signatures
from clauseloom.llm.vectors import link_vectors

from .cases import FOLDER, empty, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def groups(texts):
    sets = {d: shingles(t) for d, t in texts}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(sets, links)
    return sorted((d, len(sets[d]), root[d]) for d in sets)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(max(1, len(words)))
        words[at : at + 1] = rng.choice([[], [*words[at : at + 1], "new"], ["other"]])
    return " ".join(words)


def test_jaccard_groups_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 6, 9, 14, 22, 40, 90, 200]))] for _ in range(30)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [(n, edited(rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3, 5]), rng)) for n in range(260)]
    texts += [(300 + n, f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(25))}") for n in range(25)]
    df = frame(spark, texts)
    for tile in (1024, 3):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df, tile=tile).collect())
        assert got == groups(texts)


def test_exact_copies_link_among_unlinked_variants(spark):
    template = [f"w{n}" for n in range(44)]
    texts = [(n, " ".join([*template[: 4 + n % 36], f"x{n}", *template[5 + n % 36 :]])) for n in range(300)]
    assert all(root == d for d, _, root in groups(texts))
    texts += [(1000 + n, " ".join(template)) for n in range(8)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(frame(spark, texts)).collect())
    assert got == groups(texts) and {root for d, _, root in got if d >= 1000} == {1000}


def test_jaccard_groups_take_odd_rows(spark):
    found = jaccard_groups(frame(spark)).collect()
    assert len(found) == len(rows())
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert {r.component_id for r in found if r.doc_id in (4, 11)} == {4}
    assert all(r.n_shingles == 0 for r in found if r.doc_id in (0, 1, 2, 3))
    assert jaccard_groups(empty(spark)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in [1, 3, 4, 5, 7, 8, 12, 17, 18, 25, 60, 150, 700]:
        for _ in range(40):
            whole = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64))[: size + max(1, size // 4)]
            order = rng.permutation(whole)
            a = np.sort(order[:size])
            for drop in range(size // 5 + 1):
                for add in range((len(whole) - size) + 1):
                    b = np.sort(np.concatenate([a[rng.permutation(size)[drop:]], order[size : size + add]]))
                    common = size - drop
                    if not len(b) or 100 * common < 80 * (size + len(b) - common):
                        continue
                    if size > 30 and rng.random() < 0.97:
                        continue
                    row, key = signatures(np.concatenate([a, b]), np.array([size, len(b)]))
                    assert set(key[row == 0]) & set(key[row == 1])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound", [1, 2, 4])
def test_banded_distance(bound):
    rng = random.Random(bound)
    pairs = []
    for _ in range(800):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = list(a)
        for _ in range(rng.randrange(bound + 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + 1] = rng.choice([[], [9], [1, 2]])
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    got = within_edits([a for a, _ in pairs], [b for _, b in pairs], bound)
    assert got.tolist() == [distance(a.tolist(), b.tolist()) <= bound for a, b in pairs]


def line_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 60))) for _ in range(60)]

    def edit(line, k):
        line = list(line)
        for _ in range(k):
            at = rng.randrange(len(line) or 1)
            line[at : at + 1] = rng.choice([[], [*line[at : at + 1], "é"], ["€"]])
        return "".join(line)

    texts = [(d, "\n".join(edit(rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) if rng.random() < 0.8 else rng.choice(["short", "", " \t", "--", "-" * 10, "=" * 19, "=" * 18 + "-", "=" * 25]) for _ in range(rng.randint(0, 7)))) for d in range(90)]
    return [*texts, (500, None), (501, ""), (None, texts[3][1]), (7, texts[7][1])]


def expected_lines(texts):
    lines = sorted({line for _, t in texts for line in (t or "").split("\n") if line.strip()})
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 10)
    root = smallest(lines, [(a, b) for a, b in combinations(lines, 2) if near(a, b)])
    first = {}
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(root[line], (d, n))
    out = []
    for d, t in texts:
        lines = (t or "").split("\n")
        gone = [n for n, line in enumerate(lines) if line.strip() and first[root[line]] != (d, n)]
        out.append(((d is None, d), len(lines), len(lines) - len(gone), gone))
    return sorted(out, key=str)


def test_repeated_lines_equal_brute_force(spark):
    texts = line_texts()
    df = frame(spark, texts)
    for tile, bits in ((1024, 64), (2, 64), (1024, 4)):  # with four bits, most lines share their first name with others
        got = sorted((((r.doc_id is None, r.doc_id), r.n_lines, r.n_kept, r.removed) for r in count_repeated_lines(df, tile=tile, bits=bits).collect()), key=str)
        assert got == expected_lines(texts)


def test_dropped_lines(spark):
    texts = [(1, "this line is long enough to count\nshort\n"), (2, "this line is long enough to count\n\nshort\n--"), (3, "this line is long enough to cOunt"), (4, None), (5, ""), (6, "--\n \n----")]
    df = frame(spark, texts)
    found = drop_repeated_lines(df)
    assert found.columns == df.columns
    assert {r.doc_id: r.text for r in found.collect()} == {1: texts[0][1], 2: "\n--", 4: None, 5: "", 6: " \n----"}
    assert count_repeated_lines(frame(spark)).count() == len(rows())
    assert drop_repeated_lines(empty(spark)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    made = []
    for n in range(120):
        v = centres[n % 6] + rng.normal(size=8) * rng.choice([0.02, 0.08, 0.3])
        made.append((n, v.astype(np.float32).tolist(), int(n % 2)))
    made += [(200, made[0][1], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 0), (204, made[0][1], None), (205, [None] * 8, 0), (206, [], 0), (None, made[0][1], 0)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(5)
    good = {d: (np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), c) for d, v, c in made if d is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in combinations(sorted(good), 2) if good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.98]
    root = smallest([d for d, *_ in made if d is not None], links)
    want = sorted((d, sum(d in p for p in links), root[d]) for d in root)
    for tile in (1024, 4):
        got = [(r.vec_id, r.n_links, r.component_id) for r in link_vectors(df, tile=tile).collect()]
        assert sorted(g for g in got if g[0] is not None) == want and len(got) == len(made)
    assert link_vectors(df.where("false")).count() == 0


DENSE = """
import resource
import numpy as np
from clauseloom.llm.vectors import tile_links
rng = np.random.default_rng(1)
raws = [1 + 0.02 * rng.normal(size=(1024, 768)) for _ in range(2)]
copies = [rng.integers(1, 5, 1024) for _ in range(2)]
turn = np.linalg.qr(rng.normal(size=(768, 768)))[0]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
links, root = tile_links(raws, copies, turn, 0.98)
assert (links[:1024] == copies[1].sum()).all() and (links[1024:] == copies[0].sum()).all() and not root.any()
links, root = tile_links(raws[:1], copies[:1], turn, 0.98)
assert (links == copies[0].sum() - copies[0]).all() and not root.any()
print(before >> 10, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_tiles_full_of_near_copies_take_bounded_memory():
    done = subprocess.run([sys.executable, "-c", DENSE], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[1]) < 500  # MB in all


def test_single_and_double_precision_link_alike(spark):
    near = [1.0, 0.1, 1 / 3]
    made = [(0, near, 1), (1, [float(np.float32(x)) for x in near], 1), (2, [1e300, 1e299, 1e300 / 3], 1), (3, [1e-300, 1e-301, 1e-300 / 3], 1), (4, [0.0, 1.0, 0.0], 1), (5, [1.0, 0.1], 1)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {**{n: (3, 0) for n in range(4)}, 4: (0, 4), 5: (0, 5)}


def test_whole_tables(spark):
    from clauseloom.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op3_partenum_join(spark, FOLDER).collect()) == groups(docs)
    found = queries.op6_segment_edit_lines(spark, FOLDER).collect()
    assert {r.doc_id: r.n_lines for r in found} == {d: len(t.split("\n")) for d, t in docs}
