"""Views, scans, searches, statutes and spans: small cases by hand and plain versions of the same rules."""

import datetime
import difflib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.functions import labels as B
from clauseloom.operators import changes as C
from clauseloom.operators import chunking as K
from clauseloom.operators import history as H
from clauseloom.operators import retrieval as R
from clauseloom.operators import scan as X
from clauseloom.operators import scoring as S
from clauseloom.operators import search as P
from clauseloom.operators import statutes as L
from clauseloom.operators import views as W

TEXT = st.text("ab 1가\n.", max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_differences_lose_nothing(a, b):
    ops = W.difference(a, b)
    assert "".join(t for k, t in ops if k != "ins") == a and "".join(t for k, t in ops if k != "del") == b
    assert all(x[0] != y[0] for x, y in zip(ops, ops[1:]))
    assert "".join(t for k, t in W.difference(a, b, 0) if k != "ins") == a


def plain_fold(ops, context, least):
    out = []
    for n, (kind, text) in enumerate(ops):
        head, tail = context * (n > 0), context * (n < len(ops) - 1)
        gone = len(text) - head - tail
        if kind != "eq" or len(text) < least or gone < least // 2:
            out.append((kind, text, len(text)))
            continue
        parts = [("eq", text[:head], head), ("skip", "", gone), ("eq", text[len(text) - tail :], tail)]
        out += [p for p in parts if p[0] == "skip" or p[2]]
    return out


def plain_clip(ops, limit):
    out, used = [], 0
    for n, (kind, text, size) in enumerate(ops):
        shown = 0 if kind == "skip" else size
        if used + shown > limit:
            room = limit - used
            out += [(kind, text[:room], room)] if room else []
            return [*out, ("cut", "", shown - room + sum(s for k, _, s in ops[n + 1 :] if k != "skip"))]
        out.append((kind, text, size))
        used += shown
    return out


def test_views_equal_plain_ones(spark):
    middle = "x" * 37 + "가나다 " * 20
    pairs = [(middle + "old" + middle, middle + "new" + middle), ("a", "a"), ("", "b"), (middle, middle), ("one\n" + middle, middle + "\ntwo"), ("ab" * 30, "cd" * 30), (None, "x")]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a string, b string").withColumn("ops", W.lossless_diff(F.col("a"), F.col("b")))
    for context, least, limit in ((10, 40, 60), (5, 500, 3), (0, 20, 10_000)):
        folded = W.fold(F.col("ops"), context, least)
        for r in df.select("n", folded.alias("f"), W.clip(folded, limit).alias("c"), W.is_changed(F.col("ops")).alias("x")).collect():
            ops = W.difference(*(t or "" for t in pairs[r.n]))
            want = plain_fold(ops, context, least)
            assert [tuple(x) for x in r.f] == want and [tuple(x) for x in r.c] == plain_clip(want, limit) and r.x == any(k != "eq" for k, _ in ops)


def test_change_texts(spark):
    df = spark.createDataFrame([("회사는 7일 전 알린다", "회사는 30일 전 알린다", "head\nbody of the change", True), ("a", None, "head\n" + "b" * 30, False)], "a string, b string, p string, d boolean")
    got = [r[0] for r in df.select(W.change_body(F.col("d"), F.col("a"), F.col("b"), F.col("p"), 25)).collect()]
    assert got == ["회사는 [-7-]{+30+}일 전 알린다", "b" * 25 + "\n…(이하 5자 생략)"]
    words = df.limit(1).select(W.changed_words(F.col("a"), F.col("b")), W.changed_words(F.lit("a b c d e"), F.lit("v b w d x"), 2)).first()
    assert words[0] == "'7일' → '30일'" and words[1] == "'a' → 'v'; 'c' → 'w' 외 1곳"
    sides = df.limit(1).select(W.correction(F.col("a"), F.col("b")).alias("c"), W.one_side(W.lossless_diff(F.col("a"), F.col("b")), "del", 6).alias("o")).first()
    assert [(r.text, r.changed) for r in sides.c.before] == [("회사는 ", False), ("7일 ", True), ("전 알린다", False)]
    assert [tuple(r) for r in sides.o] == [("eq", "회사는 "), ("del", "7"), ("eq", "일")]
    kinds = spark.createDataFrame([("added", "t", None), ("removed", "t", None), ("modified", "t", "o")], "k string, t string, o string")
    assert [tuple(r[0]) for r in kinds.select(W.sides_of(F.col("k"), F.col("t"), F.col("o"))).collect()] == [("", "t"), ("t", ""), ("o", "t")]


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", max_size=14), st.text("ab ", max_size=14))
def test_similarity_is_the_matched_share(a, b):
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    far = min(matcher.real_quick_ratio(), matcher.quick_ratio()) < C.SIMILAR
    assert C.similarity(a, b) == (0.0 if far else matcher.ratio())


def test_oversized_blocks_go_by_ids(spark):
    import pandas as pd

    old = pd.DataFrame({"idx": [0, 1], "key": ["abcdefgh", "zzzz"], "title": "", "clause_id": ["x", "y"]})
    new = pd.DataFrame({"idx": [0, 1], "key": ["qqqq", "abcdefgi"], "title": "", "clause_id": ["x", "n"]})
    assert sorted((r.change_type, r.old_idx, r.new_idx) for r in C.pair_clauses(old, new, most_pairs=3).itertuples() if r.old_idx == 0) == [("modified", 0, 0)]
    chain = spark.createDataFrame(pd.concat([old.assign(version_seq=1, doc_id=5), new.assign(version_seq=2, doc_id=5)]))
    found = {n: sorted((r.change_type, r.old_idx, r.new_idx) for r in C.clause_changes(chain, most_pairs=n).collect() if r.old_idx == 0) for n in (3, 4, None)}
    assert found == {3: [("modified", 0, 0)], 4: [("modified", 0, 1)], None: [("modified", 0, 1)]}


def test_context_of_windows():
    text = "머리말 줄\n회원은 다음 각 호의 행위를 해서는 안 된다.\n1. 첫째 항목\n2. 둘째 항목\n3. 셋째 항목"
    at = text.index("3.")
    assert text[slice(*S.context_span(text, at, len("머리말 줄")))] == "회원은 다음 각 호의 행위를 해서는 안 된다."
    table = "제목\n\n| 이름 | 값 |\n| a | 1 |\n| b | 2 |\n"
    assert text and table[slice(*S.context_span(table, table.index("| b"), 2))] == "| 이름 | 값 |"
    plain = "제목\n첫 문장. 둘째 문장이다.\n- 항목\n이어지는 글"
    assert plain[slice(*S.context_span(plain, plain.index("이어"), 2))] == "둘째 문장이다."
    assert S.context_span("제목\n1. 항목", 3, 3) is None and S.last_sentence("a.  ", 2, 4) is None
    long = "가" * 300 + ":"
    assert S.context_span("제목\n" + long + "\n나머지", 3 + len(long) + 1, 2) == (3 + len(long) - S.CONTEXT_CHARS, 3 + len(long))


def test_windows_carry_notes_and_the_worst_counts(spark):
    text = "제목 줄\n다음 각 호에 해당하면 해지할 수 있다.\n" + "".join(f"{n}. 항목 {'글' * 40}\n" for n in range(1, 30)) + "BAD!! 마지막"
    df = spark.createDataFrame([(1, text, "t"), (2, "short", "t"), (3, None, "t")], "k int, x string, name string")
    windows = S.score_windows(df, "k", "x", 800, "name").orderBy("part").collect()
    assert len(windows) > 2 and {r.k for r in windows} == {1} and all(len(r.text) <= 800 for r in windows)
    assert windows[1].title == f"t (2/{len(windows)})" and "이 항의 머리말: 제목 줄" in windows[1].text and "해지할 수 있다." in windows[1].text and windows[0].context_start is None
    found = {r.k: r for r in S.score_long_units(df, "k", "x", [(-2, "BAD!!")], 800, "name").collect()}
    assert found[1].favor_score < -1 and [w.favor_score for w in found[1].windows][:-1] == [0.0] * (len(windows) - 1) and found[2].windows is None and set(found) == {1, 2, 3}


def versions(spark):
    one = "### 제1조 (목적)\n좋은 조항의 본문입니다.\n\n### 제2조 (책임)\n① 회사는 책임을 집니다.\n\n② 회원은 언제든 해지합니다.\n\n### 제3조 (삭제될 조)\n곧 없어질 나쁜 조항의 본문."
    two = "### 제1조 (목적)\n좋은 조항의 본문입니다.\n\n### 제2조 (책임)\n① 회사는 나쁜 책임을 집니다.\n\n② 회원은 언제든 해지합니다.\n\n### 제4조 (새 조)\n전혀 다른 나쁜 내용이 새로 들어왔다."
    rows = [("p", 1, "2020-01-01", None, one), ("p", 2, "2020-02-01", None, one + "  "), ("p", 3, "2020-03-01", "2020-03-11", two), ("q", 1, "2021-01-01", None, "no headings here")]
    day = datetime.date.fromisoformat
    return spark.createDataFrame([(p, s, day(d), day(e) if e else None, b) for p, s, d, e, b in rows], "path string, version_seq int, version_date date, effective_date date, body string")


def test_scan(spark):
    records, current = X.scan(versions(spark), lambda units: units.withColumn("favor_score", F.when(F.contains("text", F.lit("나쁜")), -1.0).otherwise(0.5)))
    found = {(r.path, r.seq, r.change_type, r.clause_id): r for r in records.collect()}
    assert {k for k in found if k[0] == "p" and k[1] == 1} == {("p", 1, "initial", f"제{n}조") for n in (1, 2, 3)}
    assert {k for k in found if k[0] == "p" and k[1] == 2} == {("p", 2, "modified", "제2조"), ("p", 2, "removed", "제3조"), ("p", 2, "added", "제4조")}
    changed, gone, come = (found["p", 2, k, c] for k, c in (("modified", "제2조"), ("removed", "제3조"), ("added", "제4조")))
    assert (changed.favor_score, changed.old_score, changed.score_delta, changed.became_unfavorable, changed.is_unfavorable) == (-1.0, 0.5, -1.5, True, True)
    assert [(u.clause_id, u.change_type, u.flag) for u in changed.unit_changes] == [("제2조①", "modified", "became")] and changed.lineage == "제2조@2020-01-01"
    assert gone.removed_unfavorable and gone.favor_score is None and come.became_unfavorable and come.lineage == "제4조@2020-03-01"
    assert changed.action_deadline == datetime.date(2020, 3, 10) and "책임을 집니다" in changed.old_text
    last = {(r.path, r.clause_id): r for r in current.collect()}
    assert {k for k in last} == {("p", "제1조"), ("p", "제2조"), ("p", "제4조"), ("q", "전문")} and last["p", "제1조"].lineage == "제1조@2020-01-01" and last["p", "제2조"].favor_score == -1.0


def test_history_of_a_scan(spark):
    records, current = X.scan(versions(spark), lambda units: units.withColumn("favor_score", F.when(F.contains("text", F.lit("나쁜")), -1.0).otherwise(0.5)))
    cards = spark.createDataFrame([("p", "Terms")], "path string, title string")
    tables = H.build(records, current, cards)
    counts = {r.table_name: r.n for r in H.stats(tables).collect()}
    assert counts == {"documents": 2, "versions": 3, "changes": 3, "unit_changes": 3, "clauses": 4}
    docs = {r.path: r for r in tables["documents"].collect()}
    assert (docs["p"].versions, docs["p"].title, docs["q"].title, docs["p"].latest_version) == (2, "Terms", None, datetime.date(2020, 3, 1))
    assert {r.id for r in tables["changes"].collect()} == {"p::제2조::2020-03-01::modified", "p::제3조::2020-03-01::removed", "p::제4조::2020-03-01::added"}
    asked = spark.createDataFrame([("p", "제2조", None), ("p", "제3조", None), ("q", "x", None)], "path string, clause_id string, lineage string")
    assert sorted((r.asked, r.change_type) for r in H.timeline_of(tables["changes"], tables["clauses"], asked).collect()) == [("제2조", "modified"), ("제3조", "removed")]
    ask = spark.createDataFrame([("p", "제2조@2020-01-01"), ("p", "제3조@2020-01-01"), ("p", None)], "path string, lineage string")
    assert [r.clause_id for r in H.latest_clause(tables["clauses"], ask).collect()] == ["제2조"]
    assert H.by_key(tables["documents"], cards, "path").count() == 1 and H.changes_between(tables["changes"], companies=[]).count() == 0
    assert H.changes_between(tables["changes"], "2020-02-01", "2020-03-01", "03", ["p"], "p").count() == 3 and H.newest(tables["changes"], 2).count() == 2
    sections = {r.section.split("\n")[0]: r.section for r in H.alert_texts(records).collect()}
    assert set(sections) == {"## 제2조 — changed to the worse", "## 제4조 — unfavourable clause added"}
    assert "- cause: 제2조① score +0.50 → -1.00" in sections["## 제2조 — changed to the worse"] and "act until 2020-03-10" in sections["## 제4조 — unfavourable clause added"]


def test_conditions():
    assert P.both({"path": ["a", "b"]}, {"path": {"$nin": ["b"]}}) == {"path": ["a"]}
    assert P.both({"path": {"$nin": ["b"]}}, {"path": ["a", "b"], "x": 1}) == {"path": ["a"], "x": 1}
    assert P.both({"x": 1}, {"x": 2}) == {"x": 2}


def test_predicates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "p string, n int")
    kept = lambda where: [r.n for r in df.where(P.predicate(where)).orderBy("n").collect()]
    assert kept({"p": "a"}) == [1] and kept({"p": ["a", "b"]}) == [1, 2] and kept({"p": {"$nin": ["a"]}}) == [2, 3] and kept({"p": []}) == [] and kept({"n": {"$lte": 2}, "p": {"$nin": []}}) == [1, 2]


def test_changes_that_histories_lack(spark):
    asked = spark.createDataFrame([(1, "clause_history", False, False), (2, "clause_history", True, False), (3, "current", True, True), (4, "clause_history", False, False)], "question int, intent string, dated boolean, gone boolean")
    ranked = spark.createDataFrame([(q, f"c{n}", n) for q in (1, 2, 3, 4) for n in range(1, 4)], "question int, id string, rank int")
    shown = spark.createDataFrame([(1, ["c1"]), (2, ["c1"])], "question int, changes array<string>")
    assert sorted((r.question, r.id, r.rank) for r in P.changes_for(asked, ranked, shown, 2).collect()) == [(2, "c2", 1), (2, "c3", 2), (4, "c1", 1), (4, "c2", 2)]


def test_statutes(spark):
    raw = "---\n제목: 민법\n시행일자: 2020-05-05\n---\n# 제1편 총칙\n##### 제1조 (목적)\n이 법은\n\n끝\n##### 제2조의2 (청약철회등)\n둘\n## 제2장 다른\n버림\n##### 제1조 (목적)\n다시"
    found = [(r.article, r.title, r.part, r.text) for r in L.statute_articles(spark.createDataFrame([("k", raw), ("e", ""), ("n", None)], "law string, raw string"), ["law"], "raw").orderBy("position").collect()]
    assert found == [("제1조", "목적", "제1편 총칙", "제1조 (목적)\n다시"), ("제2조의2", "청약철회등", "제1편 총칙", "제2조의2 (청약철회등)\n둘"), ("제1조", "목적", "제2장 다른", "제1조 (목적)\n다시")]
    words = spark.createDataFrame([("청약철회등의 효과",), ("광고에 관한 사항",), ("손해배상의 책임",)], "t string").select(L.title_terms(F.col("t")))
    assert [r[0] for r in words.collect()] == [["청약철회"], ["광고에", "관한"], ["손해배상", "책임"]]


def test_statutes_in_force(spark):
    day = datetime.date
    versions = spark.createDataFrame([("a", 1, day(2020, 1, 1), day(2020, 2, 1)), ("a", 2, day(2020, 1, 15), None), ("a", 3, day(2020, 3, 1), day(2021, 1, 1))], "law string, version int, promulgated date, effective date")
    asked = spark.createDataFrame([(1, "a", day(2020, 1, 10)), (2, "a", day(2020, 2, 2)), (3, "a", day(2020, 6, 1)), (4, "a", day(2021, 1, 1)), (5, "b", day(2021, 1, 1))], "q int, law string, at date")
    assert {r.q: r.version for r in L.in_force(asked, versions, ["law"], "at").collect()} == {2: 2, 3: 2, 4: 3}


def test_laws_of_evidence(spark):
    evidence = spark.createDataFrame([("C1", "now", 1), ("H1", "2020-01-01", 2)], "id string, as_of string, rank int")
    cited = spark.createDataFrame([("C1", 0, "민법", "법률", "제3조"), ("H1", 0, "민법", "법률", "제3조"), ("C1", 1, "민법", "법률", "제4조")], "id string, nth int, law string, category string, article string")
    named = spark.createDataFrame([("C1", "민법", "법률"), ("H1", "형법", "법률"), ("C1", "형법", "법률")], "id string, law string, category string")
    grades = spark.createDataFrame([("C1", 0.5), ("H1", 0.9)], "id string, grade double")
    found = [(r.as_of, r.law, r.article, r.cited_by) for r in L.laws_of_evidence(evidence, cited, named, grades, 0.7).orderBy("as_of", "place").collect()]
    assert found == [("2020-01-01", "민법", "제3조", ["H1"]), ("2020-01-01", "형법", None, ["H1"]), ("now", "민법", "제3조", ["C1"]), ("now", "민법", "제4조", ["C1"])]


@settings(max_examples=120, deadline=None)
@given(st.text("ab .\n#①", max_size=300), st.integers(6, 60), st.integers(0, 5))
def test_spans_hold_every_character(body, limit, overlap):
    spans = K.spans_of(body, limit, overlap)
    held = {n for a, b, _ in spans for n in range(a, b)}
    assert all(c.isspace() for n, c in enumerate(body) if n not in held) and all(0 < b - a <= limit for a, b, _ in spans)


def test_chunk_structure_finds_what_is_missing(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "# a\ntext\n# b\nmore text"), (3, None)], "k int, t string")
    cut = K.chunk(docs, "k", "t", {"A": (8, 0), "B": (6, 2)})
    assert [(r.k, r.way) for r in K.structure(docs, cut, "k", "t").where("missing_chars > 0 or mismatched > 0").collect()] == []
    broken = cut.where("not (k = 1 and way = 'A' and nth = 1)")
    assert [r.missing_chars > 0 for r in K.structure(docs, broken, "k", "t").where("missing_chars > 0").collect()] == [True]


def test_gold_probes_and_evaluation(spark):
    docs = spark.createDataFrame([("d", "# head\n" + "a" * 50 + "\n\n" + "b" * 60 + "\n\n| " + "c" * 60), ("e", "short")], "d string, body string")
    gold = spark.createDataFrame([(1, "d", "a" * 50 + "\r\n\r\n" + "b" * 60), (2, "d", "zzzzzzzzzzzzzzzzzzzz"), (3, "x", "a" * 50)], "q int, d string, g string")
    placed = {r.q: ([tuple(s) for s in r.spans] if r.spans else None, r.expected) for r in K.locate_gold(gold, docs, "q", "d", "g", "body").collect()}
    assert placed == {1: ([(7, 57), (59, 119)], 2), 2: (None, 1), 3: (None, 1)}
    assert [(r.d, r.start, r.end) for r in K.probes(docs, "d", "body").collect()] == [("d", 59, 119)]
    ranked = spark.createDataFrame([(1, "A", 1, "d", 0, 20), (1, "A", 2, "d", 5, 80), (1, "B", 1, "e", 0, 100), (1, "B", 6, "d", 0, 119)], "q int, way string, rank int, d string, start int, end int")
    wanted = spark.createDataFrame([(1, "d", [(7, 57), (59, 119)])], "q int, d string, spans array<struct<start:int,end:int>>")
    found = {r.way: r for r in K.evaluate(ranked, wanted, "q", "d", ["way"], budget=60).collect()}
    # the first result costs 20 characters, so of the second only 40 more count
    assert (found["A"].hit1, found["A"].hit5, found["A"].mrr5) == (0, 1, 0.5) and found["A"].coverage == pytest.approx((45 - 7) / 110)
    assert (found["B"].hit1, found["B"].hit5, found["B"].mrr5, found["B"].coverage) == (0, 0, 0.0, 0.0)


def test_spans_are_cut_to_tokens(spark):
    rows = spark.createDataFrame([("h", "one two three four", 5, 23)], "head string, text string, start int, end int")
    cut = K.fit_tokens(rows, "head", lambda t: len(t), 9).orderBy("start").collect()
    assert "".join(r.text for r in cut) == "one two three four" and all(len(r.text) <= 8 for r in cut) and [(r.start, r.end) for r in cut] == [(5, 13), (13, 21), (21, 23)]


def test_labels(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    assert one(B.names_year(F.lit("15년에"), F.lit("2015-01-01"))) and not one(B.names_year(F.lit("115년"), F.lit("2015-01-01")))
    assert one(B.is_deletion(F.lit("(삭 제)"))) is True and one(B.probability(F.lit("inf"))) is None
    assert one(B.platform_free(F.lit("a/b(X).md"), F.lit("제1조"), F.lit("2020-01-01"), F.lit("added"))) == "a/b.md::제1조::2020-01-01::added"
    assert one(B.is_company_list(F.lit("\n".join(["㈜가 x"] * 5 + ["y"] * 10)))) is True and one(B.is_company_list(F.lit("\n".join(["㈜가 x"] * 4 + ["y"] * 11)))) is False


def test_holding_equals_contains(spark):
    texts = ["a b c d e f", "xa b c d ey", "one  two", "pre one two post", "b c d", "q w e r", ""]
    passages = ["a b c d e", "b c d", "one two", "w e", "c", "a  b c", "e r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    asked = spark.createDataFrame(list(enumerate(passages)), "p int, x string")
    want = sorted((d, p) for d, t in enumerate(texts) for p, x in enumerate(passages) if x in t)
    assert sorted((r.d, r.p) for r in R.holding(docs, asked, "d", "t", "p", "x").collect()) == want


def test_citation_pattern_is_no_name(spark):
    rows = spark.createDataFrame([(1, "민 법 시행령에 따라, 그리고 민법 제 3 조"), (2, None)], "k int, t string")
    found = [(r.k, r.law, r.category) for r in L.named_statutes(rows, "k", "t", {"민법": "민법"}).collect()]
    assert found == [(1, "민법", "시행령")] and re.match(L.ARTICLE_BEHIND, " 제 3 조")
