"""Every registered query of the engine against DuckDB, and those without SQL for their rows."""

import difflib

import pytest
from pyspark.sql import functions as F

from clauseloom import catalog
from clauseloom.functions import text
from clauseloom.operators import changes as C
from clauseloom.operators import entries as N
from clauseloom.operators import scoring as S
from clauseloom.tables import version_chain

from .oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, SQL[name])


def test_clause_pairing_counts(spark):
    found = {(r.version_seq, r.change_type): r.changes for r in QUERIES["clause_pairing"](spark, FOLDER).collect()}
    exact = {r.version_seq: r for r in QUERIES["exact_key_diff"](spark, FOLDER).groupBy("version_seq").sum("same", "removed", "added").collect()}
    # the second version only removes; the third revises, so its pairs are as many as its clauses
    assert (2, "added") not in found and found[2, "unchanged"] + found[2, "removed"] <= exact[2]["sum(same)"] + exact[2]["sum(removed)"]
    assert (4, "unchanged") not in found  # settled by its hash
    assert found[3, "modified"] > 0.9 * exact[3]["sum(removed)"]


def test_windows_cover_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 800").selectExpr("doc_id", "length(text) as n")
    found = QUERIES["window_spans"](spark, FOLDER).join(docs, "doc_id")
    assert found.count() == docs.count()
    assert found.where("chars <> n or longest > 480").count() == 0


def plain_pairs(old, new):
    """Changes of two versions (idx, key), by the rules alone: equal runs, the most alike in order, then in any order."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    out, gone, come = [], [], []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [k for _, k in old], [k for _, k in new], autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("unchanged", old[i1 + n][0], new[j1 + n][0]) for n in range(i2 - i1)]
            continue
        free = list(range(j1, j2))
        for i in range(i1, i2):
            best = max(((ratio(old[i][1], new[j][1]), -j) for j in free), default=(0, 0))
            if best[0] >= 0.6:
                out.append(("modified", old[i][0], new[-best[1]][0]))
                come += [j for j in free if j < -best[1]]
                free = [j for j in free if j > -best[1]]
            else:
                gone.append(i)
        come += free
    for r, i, j in sorted(((ratio(old[i][1], new[j][1]), i, j) for i in gone for j in come), reverse=True):
        if r >= 0.6 and i in gone and j in come:
            out.append(("unchanged" if old[i][1] == new[j][1] else "modified", old[i][0], new[j][0]))
            gone.remove(i)
            come.remove(j)
    return sorted(out + [("removed", old[i][0], None) for i in gone] + [("added", None, new[j][0]) for j in come], key=str)


def test_clause_pairing_equals_plain_rules(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 1200")
    chain = version_chain(docs).select("doc_id", "version_seq", "idx", text.match_key(F.col("line")).alias("key"), F.lit("").alias("title"))
    held = {}
    for r in chain.collect():
        held.setdefault((r.doc_id, r.version_seq), []).append((r.idx, r.key))
    found = {}
    for r in C.clause_changes(chain).collect():
        found.setdefault((r.doc_id, r.version_seq), []).append((r.change_type, r.old_idx, r.new_idx))
    for (d, v), new in held.items():
        old = held.get((d, v - 1))
        if old is None:
            continue
        old, new = sorted(old), sorted(new)
        if [k for _, k in old] == [k for _, k in new]:
            assert (d, v) not in found
        else:
            assert sorted(found[d, v], key=str) == plain_pairs(old, new)


def test_pieces_hold_their_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["piece_packing"](spark, FOLDER).collect()}
    assert set(found) == set(docs)
    for d, t in docs.items():
        pieces = N.pack_units(t.split("\n"), N.PIECE_CHARS)
        assert (found[d].pieces, found[d].longest) == (len(pieces), max(map(len, pieces))) and all(len(p) <= N.PIECE_CHARS for p in pieces)
        if not any(line.startswith("|") for line in t.split("\n")):
            assert found[d].chars == len("".join(t.split()))


def test_long_units_equal_plain_windows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["long_unit_scores"](spark, FOLDER).collect()}
    windows = {}
    for r in S.score_windows(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", "text", 800).collect():
        windows.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(docs)
    for d, t in docs.items():
        own = sorted(windows.get(d, []), key=lambda r: r.part)
        assert found[d].windows == len(own) and bool(own) == (len(t) > 800)
        assert "".join("".join(t[r.start : r.end].split()) for r in own) == ("".join(t.split()) if own else "")
        for r in own:
            floor = len(t) - len(t.lstrip()) + len(next(line.strip() for line in t.split("\n") if line.strip()))
            assert ((r.context_start, r.context_end) if r.context_start is not None else None) == (S.context_span(t, r.start, floor) if r.part > 1 else None)


def test_chunks_lose_nothing(spark):
    found = QUERIES["chunk_structure"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(trim(text)) > 0").count()
    assert found.count() == 2 * docs and found.where("missing_chars > 0 or mismatched > 0").count() == 0
    assert found.where("way = 'A' and max_chars > 1500 or way = 'B' and max_chars > 750").count() == 0
    compared = QUERIES["chunk_comparison"](spark, FOLDER).where("status = 'evaluated'").collect()
    assert compared and all(0 <= r[f"{w}_{m}"] <= 1 for r in compared for w in "AB" for m in ("hit1", "hit5", "mrr5", "coverage")) and all(r.A_hit5 > 0.6 for r in compared)
