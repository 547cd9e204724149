"""A history in buckets: what look-ups find, and that they move the question alone."""

import datetime
import random

import pytest

from clauseloom.operators.history_store import write_store


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    day = datetime.date(2020, 1, 1)
    changes = [(rng.choice(["a/x.md", "a/y.md", "b/z.md", None]), rng.choice([f"l{n}" for n in range(9)] + [None]), f"c{n}", day + datetime.timedelta(rng.randrange(60)), f"text {n}") for n in range(400)]
    return changes, [(p, lin, f"{p}::{n}", "text") for n, (p, lin) in enumerate({c[:2] for c in changes})]


@pytest.fixture(scope="module")
def store(spark, made, tmp_path_factory):
    changes = spark.createDataFrame(made[0], "path string, lineage string, id string, version_date date, text string").repartition(5)
    clauses = spark.createDataFrame(made[1], "path string, lineage string, id string, text string")
    for _ in range(2):  # the second takes the place of the first
        found = write_store(changes, clauses, "held", f"file://{tmp_path_factory.mktemp('store')}", 4)
    return found


def test_look_ups_find_what_is_there(spark, made, store):
    changes, clauses = made
    asked = spark.createDataFrame([("a/x.md", "l1"), ("a/x.md", "l1"), ("b/z.md", "l8"), ("none", "l1"), ("a/x.md", None)], "path string, lineage string")
    keys = {("a/x.md", "l1"), ("b/z.md", "l8")}
    assert sorted(r.id for r in store.timelines(asked).collect()) == sorted(c[2] for c in changes if c[:2] in keys)
    assert sorted(r.id for r in store.current(asked).collect()) == sorted(c[2] for c in clauses if c[:2] in keys)
    newest = {}
    for p, lin, i, d, _ in changes:
        newest[p, lin] = max(newest.get((p, lin), (d, i)), (d, i))
    assert {(r.path, r.lineage): (r.version_date, r.id) for r in store.latest().collect()} == newest
    ids = spark.createDataFrame([("c3",), ("c3",), ("c77",), ("lost",)], "id string")
    assert sorted((r.id, r.text) for r in store.changes(ids).collect()) == [("c3", "text 3"), ("c77", "text 77")]
    days = {c[3] for c in changes if c[0] == "a/y.md"}
    found = store.versions(spark.createDataFrame([("a/y.md",)], "path string")).collect()
    assert {r.version_date for r in found} == days and sum(r.changed for r in found) == sum(c[0] == "a/y.md" for c in changes)


def moved(df):
    """Tables whose rows a plan moves: those scanned below an Exchange."""
    out, depth = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        level = len(line) - len(line.lstrip(" :+-*"))
        depth = [d for d in depth if d < level]
        if "Exchange" in line:
            depth.append(level)
        if "FileScan parquet" in line and depth:
            out.append(line)
    return out


def test_look_ups_do_not_move_the_store(spark, store):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([("a/x.md", "l1")], "path string, lineage string")
        for found in (store.timelines(pairs), store.latest(), store.current(pairs), store.changes(spark.createDataFrame([("c3",)], "id string")), store.versions(pairs), store.timelines(pairs).join(store.latest().drop("id", "version_date"), ["path", "lineage"])):
            assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString() and moved(found) == []
        assert moved(store.table("changes").groupBy("text").count())  # the test sees what is moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
