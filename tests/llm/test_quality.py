"""The line model against features, chains and scores that are computed one line at a time."""

import math
import zlib

import numpy as np
import pyarrow as pa

from clauseloom.llm import quality, queries

from .cases import FOLDER, frame

MARKS, SYMBOLS, SPACES = ".,;:'\"()-?/", "#$%&*+<=>@[\\]^_`{}~", " \t\r\x0b\x0c\n"


def plain_features(text):
    lines, out, met = (text or "").split("\n"), [], set()
    for n, line in enumerate(lines):
        raw = line.encode()
        size = len(raw)
        share = lambda chars: 10 * sum(c in chars for c in line if c.isascii()) / max(size, 1)
        spaces = sum(c in SPACES for c in line)
        words = "".join(" " if c in SPACES else c for c in line).split(" ")
        words = [w for w in words if w]
        again = sum(a == b for a, b in zip(words, words[1:]))
        kinds = [share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(MARKS), share("!"), share("|"), share(SYMBOLS), share(SPACES)]
        repeated = line in met and size > 20
        met.add(line)
        out.append([math.log1p(size) / 10, *kinds, min(size / (spaces + 1) / 10, 5) if size else 0, 10 * again / max(len(words), 1), float(repeated), float(n == 0), float(n == len(lines) - 1), 1.0])
    return np.array(out), [len(line.encode()) + 1 for line in lines]


def plain_score(model, text):
    own, weight = plain_features(text)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    unary = np.concatenate([own, before, after], axis=1) @ model.weights
    ahead, step = [], np.exp(model.transition)
    back = [np.ones(2)]
    for n, u in enumerate(unary):
        w = np.array([1.0, math.exp(max(-30, min(30, u)))])
        v = w if n == 0 else (ahead[-1] @ step) * w
        ahead.append(v / v.sum())
    for u in unary[:0:-1]:
        w = np.array([1.0, math.exp(max(-30, min(30, u)))])
        v = step @ (w * back[-1])
        back.append(v / v.sum())
    both = np.array(ahead) * np.array(back[::-1])
    good = both[:, 0] / both.sum(axis=1)
    share = min(max(float(good @ np.array(weight)) / sum(weight), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(share / (1 - share)) + model.offset)))


def test_features_equal_plain_ones():
    texts = ["", "one line", "A b\n\nTHE end!! | 12 12 x\n", "same same line that is long enough\nother\nsame same line that is long enough", "é ü\t日本 日本\n \n", "a\nb", "b", "b b\nb", "b", None, "\n\n"]
    for run in (texts, texts[::-1], texts[2:3]):
        got, weight, lines = quality.line_features(pa.array(run, pa.string()))
        want = [plain_features(t) for t in run]
        assert lines.tolist() == [len(w[1]) for w in want] and weight.tolist() == [x for w in want for x in w[1]]
        assert np.allclose(got, np.concatenate([w[0] for w in want]))


def test_registered_query_equals_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    found = {r.doc_id: r for r in queries.op2_quality_crf(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(found) == set(texts)
    for d, text in texts.items():
        r = found[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and abs(r.score - plain_score(model, text)) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_long_chains_equal_plain_ones():
    rng = np.random.default_rng(2)
    lines, transition = np.array([1, 5000, 300, 2, 257]), rng.normal(size=(2, 2))
    unary = rng.normal(size=lines.sum()) * 3
    got, expected = quality.marginals(unary, transition, lines)
    at = 0
    for n in lines.tolist():
        own, expect = quality.marginals(unary[at : at + n][:200], transition, np.array([min(n, 200)]))
        if n <= 200:
            assert np.allclose(got[at : at + n], own)
        else:  # far from the cut, what comes after does not count
            assert np.allclose(got[at : at + 100], own[:100])
        at += n
    assert math.isclose(expected.sum(), (lines - 1).sum())


def test_the_fit_is_bounded_and_takes_odd_rows(spark):
    texts = [(n, "\n".join(f"{'good words here' if n % 2 else 'BAD!! | |'} {k}" for k in range(5 + 300 * (n == 4)))) for n in range(40)]
    docs = frame(spark, [*texts, (7, "another text of that id"), (None, "no id"), (50, None)])
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)] + [(3, 0), (50, 0), (None, 1), (51, None), (99, 1)], "doc_id long, quality int")
    for blocks in (4000, 6):
        model = quality.train_quality(docs, labels, train_blocks=blocks)
        scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
        assert scores[11] > 0.5 > scores[12]
    assert quality.train_quality(docs.where("false"), labels).slope == 0
