"""Keyword search by stored postings against scores of all documents, one at a time."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauseloom import catalog
from clauseloom.operators import chunking as K
from clauseloom.operators import postings as P
from clauseloom.operators.retrieval import bm25

FOLDER = "/root/testdata/sf0.001"


def plain(docs, queries, k, allowed=lambda d: True):
    held = {d: Counter(words) for d, words in docs.items()}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for c in held.values() for t in c)
    out = []
    for q, asked in queries.items():
        scores = []
        for d, c in held.items():
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / average)) for t in set(asked) if t in c)
            if score > 0 and allowed(d):
                scores.append((-round(score, 6) + 0.0, d))
        out += [(q, rank, d, round(-s, 6)) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows(df, query, key):
    return sorted((r[query], r["rank"], r[key], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("block, levels", [(128, 16), (4, 3), (1, 1)])
def test_pruned_search_equals_all_scores(spark, monkeypatch, block, levels):
    monkeypatch.setattr(P, "BLOCK", block), monkeypatch.setattr(P, "LEVELS", levels)
    rng = random.Random(3)
    common, rare = [f"c{n}" for n in range(8)], [f"r{n}" for n in range(150)]
    docs = {n: [*rng.choices(common, k=rng.randrange(12)), *rng.choices(rare, k=rng.randrange(5))] for n in range(500)}
    docs |= {n: docs[7] for n in range(600, 640)} | {700: [], 701: ["c1"] * 300}
    queries = {n: [*rng.sample(rare, 2), *rng.sample(common, 3)] for n in range(12)} | {50: ["c0", "c0"], 51: ["unknown"], 52: []}
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()] , "d long, t string").withColumn("odd", F.col("d") % 2 == 1).repartition(5)
    asked = spark.createDataFrame([(q, " ".join(w)) for q, w in queries.items()] + [(53, None)], "q long, t string")
    index, report = P.build_postings(table, "d", "t", ("odd",)), []
    want = plain(docs, queries, 5)
    for seeds in (1, 8):
        assert rows(P.top_postings(index, asked, "q", "t", 5, seeds=seeds, report=report), "q", "d") == want
    assert all(seen <= held for held, seen in report) and (block > 100 or report[-1][1] < report[-1][0])
    assert rows(P.top_postings(index, asked, "q", "t", 5, F.col("odd")), "q", "d") == plain(docs, queries, 5, lambda d: d % 2 == 1)
    every = bm25(table, asked, "d", "t", "q", "t")
    assert {(r.q, r.d): round(r.score, 6) for r in every.collect()} == {(q, d): s for q, _, d, s in plain(docs, queries, 10_000)}


def test_an_index_without_terms(spark):
    index = P.build_postings(spark.createDataFrame([(1, None), (2, "")], "d long, t string"), "d", "t")
    asked = spark.createDataFrame([(1, "a b")], "q long, t string")
    assert index.documents == 2 and P.top_postings(index, asked, "q", "t", 3).count() == 0
    assert P.build_postings(spark.createDataFrame([], "d long, t string"), "d", "t").documents == 0


def test_both_ways_are_searched_over_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words = lambda df, text: {tuple(r[0]) if hasattr(r[0], "__len__") else r[0]: r[1] for r in df.select(df.columns[0], text).collect()}
    terms = lambda c: P.tokens(F.col(c)).alias("w")
    asked = K.probes(docs.where("doc_id % 50 = 0"), "doc_id", "text")
    queries = words(asked.select("doc_id", "question"), terms("question"))
    found = catalog.queries()["ab_spans"](spark, FOLDER).collect()
    for way in "AB":
        spans = K.chunk(docs, "doc_id", "text").where(F.col("way") == way).select(F.struct("doc_id", "start", "end").alias("s"), "text")
        want = plain(words(spans, terms("text")), queries, K.TOP)
        assert sorted((r.asked, r["rank"], (r.doc_id, r.start, r.end)) for r in found if r.way == way) == [w[:3] for w in want]
    table = {r.source: r for r in catalog.queries()["ab_search"](spark, FOLDER).collect()}
    assert set(table) == {r[0] for r in docs.select("source").distinct().collect()} and sum(r.questions for r in table.values()) == len(queries)
    assert all(r.A_hit5 >= r.A_hit1 and r.B_hit5 >= r.B_hit1 for r in table.values() if r.questions)
