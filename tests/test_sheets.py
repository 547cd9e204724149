"""Sheets, contexts and indexes on small cases."""

import datetime

from pyspark.sql import functions as F

from clauseloom.operators import contexts as T
from clauseloom.operators import indexing as I
from clauseloom.operators import linking as L
from clauseloom.operators import questions as Q
from clauseloom.operators import sheets as H
from clauseloom.operators import views as W
from clauseloom.sources import frontmatter as FM
from clauseloom.streaming import versions as SV
from clauseloom.tables import ensure_checkpoint_dir


def test_drop_review_lists_the_steepest_first(spark):
    unit = "array<struct<no:int,clause_id:string,change_type:string,favor_score:double,old_score:double,score_delta:double,flag:string,text:string,old_text:string>>"
    rows = [("p", "2020", [(0, "a", "modified", -1.0, 0.0, -1.0, "became", "new b", "old b"), (1, "b", "added", -1.0, None, None, "became", "x", None)]), ("p", "2021", [(0, "c", "modified", -1.5, 0.5, -2.0, "became", "n", "o")]), ("q", "2020", [])]
    found = H.drop_review(spark.createDataFrame(rows, f"path string, version_date string, unit_changes {unit}"), ["path", "version_date"]).collect()
    assert sorted((r.place, r.clause_id, r.changed_words) for r in found) == [(1, "c", "'o' → 'n'"), (2, "a", "'old' → 'new'")]


def test_vague_pairs_are_made_once(spark):
    rows = [(1, None, None, "accepted"), (2, None, None, " accepted "), (3, None, None, "dropped"), (4, "vague", 1, "")]
    df = spark.createDataFrame(rows, "id int, variant string, src_id int, verdict string")
    assert [r.id for r in H.without_vague_pair(df).collect()] == [2]


def test_blocks(spark):
    clause = spark.createDataFrame(
        [(1, "C1", "L", "제1조", "T", "2020-01-01", "body", ["x", "y"], [("제2조", "R", "ref" * 600)]), (1, "C2", "L", "제3조", "U", "2020-01-01", "b", None, None)],
        "question int, tag string, label string, clause_id string, title string, version_date string, text string, also_in array<string>, related array<struct<clause_id:string,title:string,text:string>>",
    )
    found = {r.tag: r.block for r in T.clause_blocks(clause).collect()}
    assert found["C1"] == "[C1] L 제1조 T (수집본 2020-01-01 버전) · 같은 내용: x, y\nbody\n\n(참조 제2조 R)\n" + "ref" * 500 and found["C2"] == "[C2] L 제3조 U (수집본 2020-01-01 버전)\nb"
    day = lambda n: datetime.date(2020, 1, n)
    rows = [(1, "T1", "L", 11, True, "a~b", n, day(n), day(n + (n == 2)), "modified", "제1조", f"b{n}") for n in range(1, 12)]
    histories = spark.createDataFrame(rows, "question int, tag string, label string, total int, matched boolean, period string, id int, version_date date, effective_date date, change_type string, clause_id string, body string")
    lines = T.timeline_blocks(histories).first().block.split("\n")
    assert lines[0] == "[T1] L — 변경 이력 (전체 11건, 질문한 기간(a~b) 해당 11건)" and lines[3] == "· 2020-01-02 개정 (수정, 시행 2020-01-03) [제1조]" and lines[5] == "(중간 변경 3건 생략)" and len(lines) == 1 + 16 + 1
    assert T.timeline_blocks(histories, True).first().block.split("\n")[2] == "b11"
    both = T.contexts([T.timeline_blocks(histories), T.clause_blocks(clause)]).first().context
    assert [b.split(" ")[0] for b in both.split(T.BETWEEN)] == ["[C1]", "[C2]", "[T1]"]
    noted = spark.range(1).select(T.with_note(F.lit("answer \n"), F.lit("note")), T.with_note(F.lit("a"), F.lit(None).cast("string")), T.used_tags(F.lit("x [C1] y [T2][C1]"))).first()
    assert tuple(noted) == ("answer\n\nnote", "a", ["C1", "T2"])


def lengths(texts):
    return [[1.0, float(len(t))] for t in texts]


def test_vectors_are_embedded_once(spark):
    ensure_checkpoint_dir(spark)
    texts = spark.createDataFrame([(n, t) for n, t in enumerate(["a", "bb", "a", "ccc"])], "n int, text string")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    found, fresh = I.cached_vectors(texts, cache, lengths, "m")
    assert {r.n: r.vector[1] for r in found.collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 3.0} and fresh.count() == 3
    assert I.cached_vectors(texts, fresh, lengths, "m")[1].count() == 0 and I.cached_vectors(texts, fresh, lengths, "other")[1].count() == 3


def test_index_follows_a_stream(spark, tmp_path):
    schema = "id string, seq int, deleted boolean, embed string, embed_hash string, text string, metadata map<string,string>"
    row = lambda i, s, t, g="g", gone=False: (i, s, gone, t, str(hash(t)), t, {"group": g})
    steps = [[row("a", 1, "one"), row("b", 1, "two"), row("a", 2, "uno!")], [row("b", 3, "two", "h"), row("c", 3, "three"), row("a", 4, "", gone=True)]]
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SV.keep_index(stream, str(tmp_path / "index"), lengths, str(tmp_path / "ck")).awaitTermination()
        held = {r.id: (r.text, r.metadata["group"], r.vector[1]) for r in I.read_index(spark, str(tmp_path / "index"), n).collect()}
        assert held == [{"a": ("uno!", "g", 4.0), "b": ("two", "g", 3.0)}, {"b": ("two", "h", 3.0), "c": ("three", "g", 5.0)}][n]
    index = I.read_index(spark, str(tmp_path / "index"), 1)
    assert [r.id for r in I.fetch(index, spark.createDataFrame([("h",)], "group string")).collect()] == ["b"]


def test_scores_are_kept_once(spark, tmp_path):
    schema = "key string, text string"
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    score = lambda units: units.withColumn("score", F.length("text"))
    for n in range(2):  # the second run has lost its checkpoint, and takes the same rows again
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SV.keep_scored(stream, score, str(tmp_path / "cache"), str(tmp_path / f"ck{n}")).awaitTermination()
        assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["a", "b"]


def test_change_and_case_views(spark):
    changes = spark.createDataFrame([("p", "l", "m", "modified", "new text", "old text"), ("p", "l", "r", "removed", "gone", None), ("p", "x", "a", "added", "come", None)], "path string, lineage string, id string, change_type string, text string, old_text string")
    clauses = spark.createDataFrame([("p", "l", "c1", "new text!")], "path string, lineage string, clause_id string, text string")
    found = {r.id: r for r in W.change_views(changes, clauses).collect()}
    assert [(o.kind, o.text) for o in found["m"].change] == [("del", "old"), ("ins", "new"), ("eq", " text")] and found["m"].latest.same is False and found["m"].latest.clause_id == "c1"
    assert found["r"].latest is None and found["a"].latest is None and [(o.kind, o.text) for o in found["r"].change] == [("del", "gone")]
    links = spark.createDataFrame([("g", "k", 0.7, 1), ("g", "lost", 0.7, 2)], "grp string, case string, score double, rank int")
    case = only_case(spark, links)
    assert [(o.kind, o.text) for o in case.before_ops] == [("eq", "회사는 "), ("del", "7"), ("eq", "일")] and [r.changed for r in case.diff.after] == [False, True]
    ok = spark.range(1).select(W.is_diffable(F.lit("modified"), F.lit("a"), F.lit("b"), F.lit(False), F.lit(False)), W.is_diffable(F.lit("modified"), F.lit(""), F.lit("b"), F.lit(False), F.lit(False))).first()
    assert tuple(ok) == (True, False)


def only_case(spark, links):
    cases = spark.createDataFrame([("k", "회사는 7일", "회사는 30일")], "case string, before string, after string")
    found = L.similar_cases(links, cases, "grp", "case").collect()
    assert len(found) == 1
    return found[0]


def test_judgements_and_selections(spark, tmp_path):
    docs = spark.createDataFrame([("q", "a/b.md", "t"), ("q", "c/d.md", "u"), ("q", "a/b.md", "t")], "kind string, path string, text string")
    keyed = docs.withColumn("key", Q.grade_key(F.col("kind"), F.struct("path", "text")))
    memo = keyed.where("path = 'c/d.md'").select("key", F.lit(0.9).alias("grade"))
    known, todo = Q.judged_once(keyed, memo)
    assert known.count() == 1 and [r.path for r in todo.collect()] == ["a/b.md"]
    assert FM.select_documents(docs, ["c/"]).count() == 1 and FM.select_documents(docs, []).count() == 3
    assert {r.company for r in FM.companies_of(docs).collect()} == {"a", "c"}
    FM.write_json(docs, str(tmp_path / "j"))
    assert FM.read_records(spark, str(tmp_path / "j"), "kind string, path string, text string").count() == 3
