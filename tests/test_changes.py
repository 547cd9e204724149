"""Changes, lineages, links and decisions on small cases."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.operators import changes as C
from clauseloom.operators import entries as N
from clauseloom.operators import linking as L
from clauseloom.operators import questions as Q
from clauseloom.operators import retrieval as R
from clauseloom.operators import scoring as S
from clauseloom.operators import versions as V
from clauseloom.streaming import versions as SV


def side(*texts, titles=None):
    return pd.DataFrame({"idx": range(len(texts)), "key": list(texts), "title": titles or [""] * len(texts)})


def kinds(found):
    return sorted((r.change_type, r.old_idx, r.new_idx) for r in found.itertuples())


def test_pairs_modified_moved_and_titled():
    one = ["the company is not liable for loss", "users may cancel at any time", "notice is given by mail"]
    assert kinds(C.pair_clauses(side(*one), side(one[0] + " at all", one[1], one[2])))[0][0] == "modified"
    moved = C.pair_clauses(side(*one), side(one[2], one[0], one[1]))
    assert set(moved["change_type"]) == {"unchanged"}
    titled = C.pair_clauses(side("abcdef", titles=["Disputes"]), side("zyxwvu", titles=["Disputes"]))
    assert kinds(titled) == [("modified", 0, 0)]
    assert sorted(C.pair_clauses(side("abcdef"), side("zyxwvu"))["change_type"]) == ["added", "removed"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=6), st.lists(st.text("abc", min_size=1, max_size=6), max_size=6))
def test_every_clause_is_in_one_change(old, new):
    found = C.pair_clauses(side(*old), side(*new))
    assert sorted(found["old_idx"].dropna()) == list(range(len(old)))
    assert sorted(found["new_idx"].dropna()) == list(range(len(new)))
    same = C.pair_clauses(side(*old), side(*old))
    assert set(same["change_type"]) <= {"unchanged"}


def test_flags(spark):
    rows = [("added", -0.7, None, "became"), ("added", -0.6, None, None), ("modified", 0.1, 0.6, "became"), ("modified", -1.0, -0.9, None), ("removed", None, -0.8, "removed"), ("removed", None, 0.0, None)]
    df = spark.createDataFrame(rows, "k string, s double, o double, want string")
    assert df.where(~C.flag(F.col("k"), F.col("s"), F.col("o")).eqNullSafe(F.col("want"))).count() == 0


def test_chain_roots(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", None)], "node string, before string")
    assert {r.node: r.root for r in V.chain_roots(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x"}


def test_citations(spark):
    texts = spark.createDataFrame([(1, "「민법」 제3조 및 같은 법 시행령 제 4 조의2, 민법 제3조"), (2, None)], "k int, t string")
    assert [(r.law, r.category, r.article) for r in L.citations(texts, "k", "t").orderBy("nth").collect()] == [("민법", "법률", "제3조"), ("민법", "시행령", "제4조의2")]


def test_covered_counts_overlaps_once(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 22), ("b", 3, 3)], "d string, s int, e int")
    assert {r.d: r.covered for r in L.covered(spans, ["d"], "s", "e").collect()} == {"a": 14, "b": 0}


def test_fuse_keeps_first_appearance(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, k int, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "q int, k int, rank int")
    assert [r.k for r in R.fuse([(one, 1.0), (two, 1.0)], "q", "k").orderBy("rank").collect()] == [10, 11]


def test_neighbours(spark):
    pieces = spark.createDataFrame([("g", n) for n in range(9)] + [("h", n) for n in range(3)], "g string, p int")
    hits = spark.createDataFrame([("g", 0), ("g", 6), ("h", 1)], "g string, p int")
    shown = R.neighbours(pieces, hits, "g", "p").collect()
    assert sorted((r.g, r.p, r.gap) for r in shown) == [("g", 0, False), ("g", 1, False), ("g", 5, True), ("g", 6, False), ("g", 7, False), ("h", 0, False), ("h", 1, False), ("h", 2, False)]


@pytest.mark.parametrize("text", ["", "x" * 2000, "A sentence. " * 200, ("line " * 30 + "\n") * 20])
def test_windows_are_whole(text):
    spans = S.cut_spans(text, 480)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(b - a <= 480 for a, b in spans)


def test_batches(spark):
    sizes = spark.createDataFrame([([5, 5, 20, 1, 9],)], "s array<int>")
    assert sizes.select(Q.fit_batches(F.col("s"), 10).alias("b")).first()["b"] == [0, 0, 1, 2, 2]


def test_stream_gates_versions(spark, tmp_path):
    rows = [("p", 1, "a"), ("p", 2, "a  "), ("p", 3, "b"), ("q", 1, "x")]
    schema = "path string, version_seq int, body string"
    for n, part in enumerate((rows[:2], rows[2:], [("p", 2, "late"), ("p", 4, "b")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = SV.changed_only(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = sorted((r.path, r.seq, r.nth) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("p", 1, 1), ("p", 3, 2), ("q", 1, 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab |\n", max_size=40), max_size=6), st.integers(4, 30))
def test_pieces_lose_nothing(units, limit):
    found = N.pack_units(units, limit)
    assert all(len(p) <= limit for p in found)
    plain = lambda parts: "".join("".join(parts).split())
    if not any(u.startswith("|") for u in units):
        assert plain(found) == plain(units)


def test_services_take_the_longer_alias(spark):
    said = spark.createDataFrame([(1, "Cloud Games and cloud"), (2, "cloudy"), (3, "클라우드게임은")], "k int, t string")
    found = N.detect_services(said, "k", "t", [("cloud", "c"), ("cloud games", "g"), ("클라우드", "k")])
    assert {r.k: r.services for r in found.collect()} == {1: ["g", "c"], 2: [], 3: ["k"]}
