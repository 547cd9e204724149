"""Whitening against exact sums and the eigenvectors of a covariance that is written out."""

from fractions import Fraction

import numpy as np
import pytest

from clauseloom.llm import queries
from clauseloom.llm.whitening import packed, squares, whiten_vectors

from .cases import FOLDER


def plain(vectors, components=4):
    """For each row (id, vector): deviation, then projections over the root of the eigenvalue, and shares."""
    points = [(d, tuple(int(np.floor(256 * float(c))) for c in v)) for d, v in vectors]
    fit = sorted({x for _, x in points})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(size)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    apart = np.array(fit, np.float64) - mean
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for d, x in points:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.setdefault(d, []).append((deviation, (np.array(x) - mean) @ axes[:, :components] / np.sqrt(values[:components])))
    return n, out, values / values.sum()


def test_registered_query_equals_plain_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    n, want, share = plain(rows)
    found = queries.op11_tsqr_whitening(spark, FOLDER).collect()
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        deviation, values = want[r.vec_id][0]
        assert r.n == n and r.deviation == deviation and r.identity_error < 1e-8
        assert abs(r.explained - share[r.component - 1]) < 1e-9
        signs.setdefault(r.component, np.sign(r.whitened * values[r.component - 1]))
        assert abs(r.whitened - signs[r.component] * values[r.component - 1]) < 1e-7


def test_many_partitions_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    made = [(n, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5] + 100).astype(np.float32).tolist()) for n in range(400)]
    made += [(n, made[7][1]) for n in range(1000, 1300)] + [(3, made[9][1]), (None, made[8][1])]
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("inf")] + [0.0] * 5), (2005, [1e30] + [0.0] * 5), (None, None)]
    df = spark.createDataFrame([(d, v, "k", 1) for d, v in made + odd], "vec_id long, embedding array<float>, size string, x int").repartition(37)
    n, want, share = plain(made)
    found = whiten_vectors(df).collect()
    assert n == 400 and len(found) == 4 * len(made) and {r.n for r in found} == {n}
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(d for rows in want.values() for d, _ in rows)
    signs = [np.sign(next(r.whitened for r in found if (r.vec_id, r.component) == (0, k + 1)) * want[0][0][1][k]) for k in range(4)]
    for r in found:
        assert min(abs(r.whitened - signs[r.component - 1] * values[r.component - 1]) for _, values in want[r.vec_id]) < 1e-8
        assert abs(r.explained - share[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
    assert whiten_vectors(df.where("false")).count() == 0 and whiten_vectors(df.where("embedding is null")).count() == 0


def test_no_variance_and_several_sizes(spark):
    made = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [4.0, 2.0]), (3, [7.0]), (4, [1.0] * 5), (5, [1.0] * 5), (6, [-0.001])]
    found = {(r.vec_id, r.component): r for r in whiten_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")).collect()}
    assert {k for k in found if k[0] == 4} == {(4, c) for c in (1, 2, 3, 4)} and (3, 2) not in found
    assert found[0, 2].whitened is None and found[0, 2].explained == 0 and abs(found[0, 1].explained - 1) < 1e-12
    assert found[4, 1].whitened is None and found[4, 1].explained is None and found[4, 1].identity_error is None and found[4, 1].deviation == 0
    assert found[3, 1].n == 2 and abs(abs(found[3, 1].whitened) - 1) < 1e-12 and found[3, 1].deviation == (256 * 7 + 1) ** 2


def test_exact_arithmetic():
    rows = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [2**31, 2**31], [5_000_000_000, 1], [-1, 1]])
    exact = [sum(int(x) ** 2 for x in row) for row in rows]
    want = [x if x < 2**63 else None for x in exact]
    assert squares(rows) == want and squares(rows.astype(object)) == want
    assert [len(x) for x in packed(np.array([[1, -128], [1, 128], [40_000, 0], [2**40, 0]]))] == [2, 4, 8, 16]


@pytest.mark.parametrize("shift", [0, 1e6])
def test_digits_survive_large_means(spark, shift):
    rng = np.random.default_rng(2)
    made = [(n, (rng.normal(size=3) * [1, 0.1, 0.01] * 40 + shift).tolist()) for n in range(200)]
    found = whiten_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>"), components=3).collect()
    assert {r.identity_error < 1e-9 for r in found} == {True}
