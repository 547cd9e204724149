"""Ranked search against scores of all documents, one at a time."""

import math
import random
import re
from collections import Counter

from clauseloom.llm import queries, ranked

from ..oracle import connect, same
from .cases import FOLDER, empty, frame, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 50 + (50 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_registered_query_equals_plain_scores_and_duckdb(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op13_block_max_search(spark, FOLDER)
    assert found(got) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    same(got, connect(FOLDER), ranked.search_oracle())


def test_pruned_blocks_lose_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    common, rare = [f"c{n}" for n in range(20)], [f"r{n}" for n in range(400)]
    docs = [(n, " ".join([*rng.choices(common, k=rng.randrange(30)), *rng.choices(rare, k=rng.randrange(4))])) for n in range(900)]
    docs += [(n, docs[5][1]) for n in range(2000, 2080)] + [(7, "r1 r2 R3"), (None, "r1 r2 r3"), (3000, None), (3001, "--")]
    items = [(n, " ".join(rng.sample(rare, 3) + rng.sample(common, 2))) for n in range(30)]
    items += [(0, "r1"), (None, "r1 c1"), (40, None), (41, "?!"), (42, "unheard"), (43, "r1 R1 r1, r2")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = ranked.build_index(frame(spark, docs), f"file://{tmp_path}/index", block_docs=4)
    assert index.blocks.count() >= len(docs) / 4
    for k, rounds, batch in ((5, (1, 4), 512), (5, (2,), 7), (50, (8, 64), 512)):
        monkeypatch.setattr(ranked, "BATCH_QUERIES", batch)
        report = []
        got = ranked.search_index(index, asked, k, rounds=rounds, report=report)
        assert found(got) == plain(docs, items, k)
        if k == 5:
            assert sum(sum(v) for v, _ in report) < sum(p for _, p in report)
        assert len(report) == -(-sum(bool(terms(t)) for _, t in items) // batch)
    monkeypatch.setattr(ranked, "BROADCAST_VISITS", 0)
    assert found(ranked.search_index(index, asked, 5)) == plain(docs, items, 5)


def test_odd_rows(spark):
    docs, asked = frame(spark), spark.createDataFrame([(1, "one ÜNÏ alpha w x"), (2, ""), (3, None), (1, "line 日本語")], "item_id int, text string")
    assert found(ranked.search_documents(docs, asked)) == plain(rows(), [(r.item_id, r.text) for r in asked.collect()], 50)
    assert ranked.search_documents(empty(spark), asked).count() == 0
    assert ranked.search_documents(docs, asked.where("false")).count() == 0
