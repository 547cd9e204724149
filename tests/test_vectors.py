"""Searches over vectors that rank nothing: all links, and counts of all candidates."""

import numpy as np

from clauseloom.operators import cells as V
from clauseloom.operators.retrieval import vector_counts, vector_links, vector_top


def test_links_and_counts_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    made = [(n, rng.normal(size=6).tolist(), n % 3) for n in range(90)]
    made += [(90 + n, made[n][1], made[n][2]) for n in range(9)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label long").repartition(4)
    unit = {d: np.array(v) / np.linalg.norm(v) for d, v, _ in made}
    label = {d: c for d, _, c in made}
    asked = [d for d in unit if d % 10 == 0]
    queries = df.where("vec_id % 10 = 0")
    want = sorted((q, d) for q in asked for d in unit if d != q and unit[q] @ unit[d] >= 0.3)
    assert sorted((r.query_id, r.vec_id) for r in vector_links(df, queries, 0.3, cells=5).collect()) == want
    found = {r.query_id: (r.candidates, r.best) for r in vector_counts(df, queries, same="label", cells=5).collect()}
    for q in asked:
        others = [d for d in unit if d != q and label[d] == label[q]]
        assert found[q] == (len(others), min(others, key=lambda d: (-round(unit[q] @ unit[d], 12), d)))


def plain_top(rows, asked, k, same=False):
    unit = {d: np.array(v) / np.linalg.norm(v) for d, v, _ in rows}
    label = {d: c for d, _, c in rows}
    out = []
    for q in asked:
        others = sorted((-round(float(unit[q] @ unit[d]), 12), d) for d in unit if d != q and len(unit[d]) == len(unit[q]) and (not same or label[d] == label[q]))
        out += [(q, n, d) for n, (_, d) in enumerate(others[:k], 1)]
    return sorted(out)


def test_cells_leave_out_blocks_and_no_result(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16), monkeypatch.setattr(V, "QUERIES", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    made = [(n, (centres[n % 12] + 0.05 * rng.normal(size=8)).tolist(), n % 3) for n in range(600)]
    made += [(700 + n, rng.normal(size=5).tolist(), 0) for n in range(9)]
    odd = [(800, None, 0), (801, [], 0), (802, [float("nan")] * 8, 0), (803, [1.0, None] * 4, 0)]
    df = spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, label long").repartition(6)
    queries, asked = df.where("vec_id % 20 = 0"), [d for d, *_ in made if d % 20 == 0]
    report = []
    got = V.top_cells(V.build_cells(df, cells=12), queries, 4, report=report)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == plain_top(made, asked, 4)
    visited, pairs = report[0]
    assert visited < 0.4 * pairs
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    for cells in (1, 7):
        got = vector_top(df, queries, 5, same="label", cells=cells)
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == plain_top(made, asked, 5, same=True)
    assert vector_top(df.where("false"), queries, 5).count() == 0
