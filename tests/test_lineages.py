"""Lineages of clauses by their keys."""

from pyspark.sql import functions as F

from clauseloom import catalog, tables
from clauseloom.operators import versions as V


def test_lineages_by_key_count_repeats_within_a_version(spark):
    rows = [(1, 1, 0, "a"), (1, 1, 1, "a"), (1, 2, 3, "a"), (1, 2, 4, "b"), (1, 3, 9, None), (2, 2, 0, "a")]
    found = V.key_lineages(spark.createDataFrame(rows, "d long, v int, n int, k string"), "d", "v", "n", "k")
    got = {(r.d, r.k, r.nth, r.first.v, r.first.n, r.versions) for r in found.collect()}
    assert got == {(1, "a", 1, 1, 0, 2), (1, "a", 2, 1, 1, 1), (1, "b", 1, 2, 4, 1), (1, None, 1, 3, 9, 1), (2, "a", 1, 2, 0, 1)}


def test_lineages_of_lines_move_rows_once(spark):
    plan = catalog.queries()["lineage_of_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_chain_of_keys_is_the_keys_of_the_chain(spark):
    docs = spark.createDataFrame([(1, "s", "en", "\n".join(f"line {n}" for n in range(12))), (2, "s", "en", ""), (3, "s", "en", None)], "doc_id long, source string, lang string, text string")
    want = tables.version_chain(docs).withColumn("line", F.md5("line"))
    assert sorted(tables.version_chain(docs, F.md5).collect()) == sorted(want.collect())
