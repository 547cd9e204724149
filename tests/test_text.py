"""Text functions on cases worked out by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import dates, text
from clauseloom.operators import scoring
from clauseloom.operators import versions as V
from clauseloom.sources import frontmatter, html


def value(spark, raw, column):
    return spark.createDataFrame([(raw,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("## Title\r\n\r\na 　b ", "Title\na b"),
        ("|x|  y |", "| x | y |".strip()),
        ("“a” – b\n조회 수: 12\ntop", '"a" - b'),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, raw, want):
    got = value(spark, raw, text.normalize)
    assert (got.strip() if got else got) == want


def test_match_key_ignores_numbers_and_spaces(spark):
    assert value(spark, "⑦ 회사는  책임을", text.match_key) == value(spark, "⑧ 회사는 책임을", text.match_key) == "회사는책임을"


def test_lists_and_lines(spark):
    assert value(spark, "| a |\n| b |", text.is_list) is True
    assert value(spark, "\n".join(["short"] * 15), text.is_list) is True
    assert value(spark, "\n".join(["short"] * 14), text.is_list) is False
    assert value(spark, " \n\n", text.is_list) is False
    assert value(spark, "\n  first \nsecond", text.first_line) == "first"


def test_tokens_pair_hangul_across_spaces(spark):
    assert value(spark, "환불 Up2 약", text.tokens) == ["up2", "환불", "불약"]


def test_kinds(spark):
    assert value(spark, "개인 정보 처리 방침", text.document_kind) == "개인정보처리방침"
    assert value(spark, "개인정보 수집 동의", text.document_kind) == "동의서"
    assert value(spark, "이용 약관", text.document_kind) == "약관"
    assert value(spark, "x", text.document_kind) == "기타"


D = datetime.date


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024년 3월에 바뀐 것", (D(2024, 3, 1), D(2024, 3, 31))),
        ("2020년 이후", (D(2020, 1, 1), None)),
        ("2020년 이전", (None, D(2019, 12, 31))),
        ("2020년까지", (None, D(2020, 12, 31))),
        ("2021-02-03 과 2023년", (D(2021, 2, 3), D(2023, 12, 31))),
        ("2021-13-01", None),
        ("없음", None),
    ],
)
def test_date_range(spark, raw, want):
    got = value(spark, raw, dates.date_range)
    assert (None if got is None else tuple(got)) == want


def test_month_day(spark):
    assert value(spark, "7월 25일에 뭐가", dates.month_day) == "07-25"
    assert value(spark, "2024년 7월 25일", dates.month_day) is None
    assert value(spark, "13월", dates.month_day) is None


def test_headings(spark):
    assert tuple(value(spark, "제 3 조의2 [정의]", V.article_name)) == ("제3조의2", "정의")
    assert tuple(value(spark, "1. 기본", V.article_name)) == ("1.", "기본")
    assert tuple(value(spark, "부 칙", V.article_name)) == ("부칙", "부칙")
    assert value(spark, "서문", V.article_name) is None


def test_clauses(spark):
    body = "머리\n\n# 약관\n## 제1조 (목적)\n본문\n\n① 하나\n\n② 둘\n\n- 목록\n## 제2조 (정의)\n내용\n## 부칙\n끝\n## 부칙\n또"
    bodies = spark.createDataFrame([("p", body)], "path string, body string")
    units = [(r.clause_id, r.text) for r in V.clauses_by_paragraph(bodies, "path", F.col("body")).orderBy("ord").collect()]
    assert units == [("전문", "머리"), ("제1조", "본문"), ("제1조①", "① 하나"), ("제1조②", "② 둘\n\n- 목록"), ("제2조", "내용"), ("부칙", "끝\n\n또")]
    whole = [(r.clause_id, r.title, len(r.parts)) for r in V.clauses_by_article(bodies, "path", F.col("body")).orderBy("ord").collect()]
    assert whole == [("전문", "", 0), ("제1조", "목적", 3), ("제2조", "정의", 0), ("부칙", "부칙", 0)]


def test_front_matter(spark):
    got = value(spark, '---\na: "x \\"y\\""  # c\nb: null\nb: 2\n---\n\nbody', frontmatter.split_front_matter)
    assert got.meta == {"a": 'x "y"', "b": "2"} and got.body == "body"
    assert value(spark, "plain", frontmatter.split_front_matter).body == "plain"


def test_pages(spark):
    assert value(spark, "<p>a &lt;b&gt;</p><script>x</script>\n<b>c</b>", html.visible_text) == "a <b> c"


def plain_cuts(text, budget):
    """Every admissible end of a span is tried, the furthest first."""
    spans, start = [], 0
    while len(text) - start > budget:
        low, reach = start + budget // 3, start + budget
        feeds = [e for e in range(reach - 1, low - 1, -1) if text[e] == "\n" and e > start]

        def behind_sentence(e):
            a = e
            while a > start and text[a - 1].isspace():
                a -= 1
            return start < a < e and text[a - 1] in ".!?。" and (e == reach or not text[e].isspace())

        ends = feeds or [e for e in range(reach, low - 1, -1) if behind_sentence(e)]
        spans.append((start, ends[0] if ends else reach))
        start = spans[-1][1]
    return [*spans, (start, len(text))]


def test_windows_end_where_the_rule_says():
    rng = random.Random(8)
    for budget in (3, 10, 37):
        for _ in range(300):
            text = "".join(rng.choice(["a", "bc", ". ", "!  ", "。\n", "\n", " ", "?", "가"]) for _ in range(rng.randrange(80)))
            assert scoring.cut_spans(text, budget) == plain_cuts(text, budget)


def test_months_without_a_year(spark):
    said = {"15년 7월에 바뀐 조항": None, "24년 3월 5일 개정": None, "7월 25일 개정": "07-25", "3월": "03", "2020년 3월": None, "13월": None, "작년12월 1일": None, "작년 12월 1일": "12-01", "지난 12월 1일": "12-01", "15년 7월 말고 8월": "08", "": None, None: None}
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", dates.month_day(F.col("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == said
