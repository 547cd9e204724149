"""An index that is changed step by step, with steps that break off anywhere."""

import random

import pytest

from clauseloom import tables
from clauseloom.operators import index_table as T
from clauseloom.operators import indexing as I

KINDS = "id string, embed string, embed_hash string, text string, metadata map<string,string>"


def lengths(texts):
    return [[1.0, float(len(t))] for t in texts]


def broken(texts):
    raise RuntimeError("no vectors today")


def wanted(spark, entries):
    return spark.createDataFrame([(i, t, t[:6], t, {"group": g}) for i, (t, g) in entries.items()], KINDS)


def held(spark, path, number=None):
    return {r.id: (r.text, r.metadata["group"], r.vector[1]) for r in I.read_index(spark, path, number).collect()}


def expected(entries):
    return {i: (t, g, float(len(t))) for i, (t, g) in entries.items()}


def test_steps_write_their_rows_alone(spark, tmp_path):
    path, rng, entries, states = str(tmp_path / "index"), random.Random(1), {}, []
    for number in range(6):
        entries = {i: e for i, e in entries.items() if rng.random() > 0.2}
        entries |= {f"e{rng.randrange(30)}": (f"{rng.random()} text", rng.choice("ab")) for _ in range(8)}
        entries |= {i: (t, rng.choice("ab")) for i, (t, _) in entries.items() if rng.random() < 0.3}
        before = held(spark, path)
        counts = {r.action: r.ids for r in I.upsert(spark, wanted(spark, entries), path, number, lengths).collect()}
        states.append(expected(entries))
        assert held(spark, path) == states[-1]
        table = T.Table(spark, path)
        own = table.read(table.manifest(number)["folders"][-1:])
        touched = {i for i in before.keys() | states[-1].keys() if before.get(i) != states[-1].get(i)}
        assert {r.id for r in own.collect()} == touched and {r.id for r in own.where("deleted").collect()} == before.keys() - states[-1].keys()
        assert counts.get("delete", 0) == len(before.keys() - states[-1].keys()) and counts.get("insert", 0) == len(states[-1].keys() - before.keys())
    assert [held(spark, path, n) for n in range(6)] == states
    assert {r.action: r.ids for r in I.upsert(spark, wanted(spark, {}), path, 5, broken).collect()} == counts and held(spark, path) == states[-1]


@pytest.mark.parametrize("step", ["write", "commit", "embed"])
def test_a_step_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    first, second = {"a": ("one", "g"), "b": ("two", "g")}, {"a": ("one", "h"), "c": ("three", "g")}
    I.upsert(spark, wanted(spark, first), path, 0, lengths)
    with monkeypatch.context() as m:
        if step != "embed":
            whole = getattr(T.Table, step)

            def half(self, *args, **kw):
                if step == "write":
                    whole(self, *args, **kw)  # the rows are there, but nobody names them
                raise RuntimeError("lost")

            m.setattr(T.Table, step, half)
        with pytest.raises(Exception):
            I.upsert(spark, wanted(spark, second), path, 1, broken if step == "embed" else lengths)
    assert held(spark, path) == expected(first)
    I.upsert(spark, wanted(spark, second), path, 1, lengths)
    assert held(spark, path) == expected(second) and held(spark, path, 0) == expected(first)
    table = T.Table(spark, path)
    left = table.vacuum()
    assert held(spark, path) == expected(second) and table.versions() == [1]
    assert step == "embed" or any(n.startswith("data/") for n in left)


def test_compaction_keeps_rows_and_numbers(spark, tmp_path):
    path = str(tmp_path / "index")
    for n in range(4):
        changes = wanted(spark, {f"e{n}": (f"text {n}", "g"), "same": ("always", "g")}).selectExpr("*", "false as deleted")
        I.apply_changes(spark, changes.unionByName(spark.createDataFrame([("e0", None, None, None, None, True)], changes.schema)) if n == 3 else changes, path, n, lengths)
    before, table = held(spark, path), T.Table(spark, path)
    assert set(before) == {"e1", "e2", "e3", "same"} and not T.compact(table, 5)
    assert T.compact(table, 4) and len(table.manifest(3)["folders"]) == 1 and table.versions() == [0, 1, 2, 3]
    assert held(spark, path) == before
    gone = table.vacuum()
    assert len([n for n in gone if n.startswith("data/")]) == 4 and held(spark, path) == before
    I.apply_changes(spark, wanted(spark, {"e9": ("new", "g")}).selectExpr("*", "false as deleted"), path, 4, lengths)
    assert held(spark, path) == before | {"e9": ("new", "g", 3.0)}
    assert T.Table(spark, str(tmp_path / "none")).versions() == [] and I.read_index(spark, str(tmp_path / "none")).count() == 0


def test_a_step_writes_the_index_alone_and_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    path, written = str(tmp_path / "index"), []
    monkeypatch.setattr(tables, "stored", lambda df: written.append(df) or df)
    monkeypatch.setattr(I, "stored", tables.stored, raising=False)
    I.upsert(spark, wanted(spark, {"a": ("one", "g"), "b": ("two", "g"), "c": ("", "g")}), path, 0, lambda texts: [[1.0, 1.0]] * len(texts))
    I.upsert(spark, wanted(spark, {"a": ("one", "h"), "b": ("two", "g")}), path, 1, broken)
    assert not written and {i: (t, g) for i, (t, g, _) in held(spark, path).items()} == {"a": ("one", "h"), "b": ("two", "g")}
    plan = I.read_index(spark, path).select("id", "vector")._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "metadata:map" not in plan
