"""Queries over names of documents, small decisions about texts and questions, and sheets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions.text import clip
from ..operators import views as W
from ..tables import table
from .text_queries import FULL_LINES_SQL, quote

#: Paths, services and titles of the synthetic tables take turns.
PATHS = ["krafton/pubg/Terms(Steam).md", "coupang/terms.md", "kt/mobile/policy(web).md", "toss/pay/notice.md", "single.md", "kt/terms.md", "krafton/pubg/Terms(Xbox).md"]
NAMES = {"krafton/pubg": "Battlegrounds", "coupang": "Coupang", "kt": "KT"}
QUESTIONS = [
    "When did the eats terms change? 언제 바뀌었어", "환불 조건 알려줘", "2024년 이후 바뀐 것", "7월 25일 개정", "SLA 가용률은?", "스팀 판은 없어졌나", "2020년 3월 5일까지 삭제된 조항", "steam or xbox terms, 15년",
]
ALIASES = [("(Steam)", "steam"), ("(Steam)", "스팀"), ("eats", "eats"), ("(Xbox)", "xbox")]
SERVICES = [[], ["kt"], ["krafton/pubg"], ["krafton/pubg", "kt"], ["krafton/pubg", "krafton"], ["kt", "toss"]]
GUESSES = [(None, None, None), ("current", "2024-01-01", None), ("doc_history", "2019-05-05", "2019-06-05"), ("nonsense", None, "2015-01-01")]
CORRECTIONS = ["(삭제)", "제3조 삭제", "이 조항은 모두 삭제", "이 조항은 길게 설명되어 있으며 삭제", "남음", ""]
ANSWERS = ['{"questions": ["one?", " two? ", "one?", ""]}', '{"questions": "x"}', "not json", '{"questions": ["a", "b", "c", "d"]}', "{}"]


def _pick(values: list, by: Column) -> Column:
    def lit(v):
        if isinstance(v, (list, tuple)):
            return F.array(*map(F.lit, v)).cast("array<string>")
        return F.lit(v).cast("string")

    return F.element_at(F.array(*map(lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list, by: str) -> str:
    lit = lambda v: "null" if v is None else "[" + ", ".join(map(quote, v)) + "]::varchar[]" if isinstance(v, list) else quote(v)
    return f"(case {by} % {len(values)} " + " ".join(f"when {n} then {lit(v)}" for n, v in enumerate(values)) + " end)"


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that documents go by: file names, labels, keys that platforms share, names of their index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _pick(PATHS, F.col("doc_id")).alias("path"))
    service = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    clause = F.concat(F.lit("제"), (F.col("doc_id") % 5).cast("string"), F.lit("조#2"))
    title = F.when(F.col("doc_id") % 4 > 0, F.col("lang"))
    model = _pick(["vendor/plain-small", "Org/Ko Embed_v1.5!", "x"], F.col("doc_id"))
    return docs.select(
        "doc_id", B.slug(F.col("path")).alias("slug"), B.article_of(clause).alias("article"), B.platform_free(F.col("path"), clause).alias("shared"), B.document_label(service, F.col("path"), title, NAMES).alias("label"),
        B.document_name(F.col("path"), title, NAMES).alias("name"), B.collection_name(F.lit("clauses"), F.col("lang"), model, "vendor/plain-small").alias("collection"), B.evidence_company(F.concat(F.lit("C:"), "path", F.lit("::"), clause)).alias("company"),
        B.law_display(F.lit("표시ㆍ광고법"), _pick(["법률", "시행령"], F.col("doc_id"))).alias("law"),
    )


def text_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts are: lists of companies, too bulky to compare, mere deletions; and scores as they are shown."""
    docs = table(spark, sf_dir, "documents")
    lines = _pick(["(주)가나다 위탁 업무\n", "BC카드㈜ 결제\n", "plain line\n", "| 한국은행 | x |\n"], F.col("doc_id"))
    text = F.when(F.col("doc_id") % 3 == 0, F.repeat(lines, (F.col("doc_id") % 40).cast("int"))).otherwise(F.col("text"))
    said = docs.select("doc_id", text.alias("text"), _pick(CORRECTIONS, F.col("doc_id")).alias("after"), _pick(["jev-1", "rules", None], F.col("doc_id")).alias("scorer"))
    score = F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 401) / 100 - 2)
    shown = B.favour(score, F.col("scorer"), F.when(F.col("doc_id") % 2 == 0, F.lit(0.125)), "jev")
    guess = _pick(["0.5", "1.5", "NaN", "-0.1", "x", None, "1"], F.col("doc_id"))
    companies = F.coalesce(B.is_company_list(F.col("text")), F.lit(False))
    return said.select(
        "doc_id", companies.alias("companies"), F.coalesce(W.is_bulky(F.col("text"), companies), F.lit(False)).alias("bulky"), B.is_deletion(F.col("after")).alias("deletion"),
        F.round(shown["favor_score"], 2).alias("favor"), shown["favor_old"].alias("favor_old"), B.probability(guess).alias("probability"),
    )


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask for: current text or history, dates of their own or guessed, service levels, documents and companies."""
    by = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(by, _pick(QUESTIONS, by).alias("q"), _pick(SERVICES, F.floor(by / 3)).alias("services"), *(_pick([g[n] for g in GUESSES], F.floor(by / 5)).alias(c) for n, c in enumerate(("intent", "date_from", "date_to"))))
    plan = B.plan(F.col("q"), F.struct("intent", "date_from", "date_to"))
    kept = B.service_filter(F.col("services"))
    return asked.select(
        by, plan.alias("p"), F.col("q").rlike(B.SERVICE_LEVEL).alias("service_level"), F.array_join(B.preferred(F.col("q"), ALIASES), ",").alias("preferred"), B.single_company(F.col("services")).alias("company"),
        F.array_join(kept["service"], ",").alias("only_services"), F.array_join(kept["company"], ",").alias("only_companies"),
    ).select("o_orderkey", "p.*", "service_level", "preferred", "company", "only_services", "only_companies")


def follow_up_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", _pick(ANSWERS, F.col("p_partkey")).alias("raw"), _pick(["one?", "c", "none"], F.col("p_partkey")).alias("q"))
    return parts.select("p_partkey", F.array_join(B.suggestions(F.col("raw"), F.col("q")), "|").alias("questions"))


def sheet_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet that are filled in, by source, and the tokens that embedding their texts would take at most."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("answer")), "doc_id", "left")
    done = F.count(F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", 1))
    return docs.groupBy("source").agg(F.count("*").alias("total"), done.alias("done"), F.sum(F.length("text")).alias("tokens"), F.max(F.length(clip(F.col("text"), 100, "…"))).cast("long").alias("longest"))


_TEXT = f"(case when doc_id % 3 = 0 then repeat({_pick_sql(['(주)가나다 위탁 업무' + chr(10), 'BC카드㈜ 결제' + chr(10), 'plain line' + chr(10), '| 한국은행 | x |' + chr(10)], 'doc_id')}, (doc_id % 40)::int) else text end)"
_DATES = {0: (None, None, None), 1: (None, None, None), 2: ("2024-01-01", None, None), 3: (None, None, "07-25"), 4: (None, None, None), 5: (None, None, None), 6: (None, "2020-03-05", None), 7: (None, None, None)}


def _plan_sql(n: int) -> str:
    """DuckDB's plan of the n-th question: its own dates as they are written out above, and the guess's where their years are named."""
    first, last, month = _DATES[n]
    own = first or last
    question = QUESTIONS[n]
    rows = []
    for g, (intent, a, b) in enumerate(GUESSES):
        named = lambda d: d is None or d[:4] in question or re.search(rf"(?<!\d){d[2:4]}\s*년", question) is not None
        sure = named(a) and named(b)
        x, y = (first, last) if own else ((a, b) if sure else (None, None))
        kind = intent if intent in ("current", "clause_history", "doc_history") else "clause_history" if re.search(B.HISTORY, question) else "current"
        if kind == "current" and (x or y or month or re.search(B.GONE, question)):
            kind = "clause_history"
        rows.append((n, g, kind, x, y, month))
    return ", ".join("(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else quote(v) for v in r) + ")" for r in rows)


_SUBS = [",".join(sorted({*s, *(x.split("/")[0] for x in s)})) if s and all(any(y.split("/")[0] == x.split("/")[0] and "/" in y for y in s) for x in s) else None for s in SERVICES]
_COMPANIES = [",".join(sorted({x.split("/")[0] for x in s})) if s and sub is None else None for s, sub in zip(SERVICES, _SUBS)]
_SINGLE = [next(iter({x.split("/")[0] for x in s})) if len({x.split("/")[0] for x in s}) == 1 else None for s in SERVICES]
_COMPANY_LINE = B.COMPANY_LINE.replace("'", "''")

QUERIES = {
    "document_labels": (
        document_labels,
        f"""with d as (select doc_id, lang, {_pick_sql(PATHS, 'doc_id')} path, '제' || doc_id % 5 || '조#2' c, case when doc_id % 4 > 0 then lang end t, {_pick_sql(['vendor/plain-small', 'Org/Ko Embed_v1.5!', 'x'], 'doc_id')} model from documents),
s as (select *, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end sv, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else path end folder, nullif(regexp_extract(path, '\\(([^()]*)\\)(?:\\.[A-Za-z]+)?$', 1), '') pf from d)
select doc_id, replace(regexp_replace(path, '\\.md$', ''), '/', '__') as slug, string_split(c, '#')[1] as article, regexp_replace(path, '\\([^)]*\\)\\.md$', '.md') || '::' || c || '::::' as shared,
coalesce(case sv when 'krafton/pubg' then 'Battlegrounds' when 'coupang' then 'Coupang' when 'kt' then 'KT' end, case string_split(sv, '/')[1] when 'coupang' then 'Coupang' when 'kt' then 'KT' end, sv) || ' · ' || coalesce(t, '') || coalesce(' (' || pf || ')', '') as label,
coalesce(case folder when 'krafton/pubg' then 'Battlegrounds' when 'coupang' then 'Coupang' when 'kt' then 'KT' end, case string_split(folder, '/')[1] when 'coupang' then 'Coupang' when 'kt' then 'KT' end, folder) || ' · ' || coalesce(t, '') || coalesce(' (' || pf || ')', '') as name,
case when model = 'vendor/plain-small' then 'clauses_' || lang when model = 'x' then 'clauses_' || lang || '__x' else 'clauses_' || lang || '__ko-embed-v1-5' end as collection, string_split(path, '/')[1] || case when contains(path, '/') then '' else '::' || c end as company,
'표시·광고법' || case when doc_id % 2 = 0 then '' else ' 시행령' end as law from s""",
    ),
    "text_decisions": (
        text_decisions,
        f"""with d as (select doc_id, {_TEXT} text, {_pick_sql(CORRECTIONS, 'doc_id')} a, {_pick_sql(['jev-1', 'rules', None], 'doc_id')} scorer from documents),
l as (select *, {FULL_LINES_SQL} fl from d), m as (select *, list_transform(fl, lambda s: regexp_replace(regexp_replace(s, '^\\|+', ''), '^\\s+|\\s+$', '', 'g')) x from l),
k as (select *, coalesce(len(x) >= 15 and len(list_filter(x, lambda s: regexp_matches(s, '{_COMPANY_LINE}'))) / len(x) >= 0.3, false) companies,
coalesce(len(fl) > 0 and (len(list_filter(fl, lambda s: starts_with(s, '|'))) / len(fl) >= 0.8 or (len(fl) >= 15 and list_sum(list_transform(fl, lambda s: length(s))) / len(fl) <= 25)), false) listed from m)
select doc_id, companies, coalesce(length(text) > 20000 or (length(text) > 5000 and (listed or companies)), false) as bulky, doc_id % 6 in (0, 1, 2) as deletion,
case when doc_id % 7 > 0 and scorer = 'jev-1' then round((doc_id % 401) / 100 - 2, 2) end as favor, case when doc_id % 7 > 0 and scorer = 'jev-1' and doc_id % 2 = 0 then 0.13 end as favor_old,
case doc_id % 7 when 0 then 0.5 when 6 then 1.0 end::double as probability from k""",
    ),
    "question_plans": (
        question_plans,
        f"""with p(n, g, intent, date_from, date_to, month_day) as (values {', '.join(_plan_sql(n) for n in range(len(QUESTIONS)))}), o as (select o_orderkey, o_orderkey % {len(QUESTIONS)} n, (o_orderkey // 5) % {len(GUESSES)} g, (o_orderkey // 3) s from orders)
select o_orderkey, intent, date_from, date_to, month_day, n = 4 as service_level, case n when 0 then 'eats' when 5 then '(Steam)' when 7 then '(Steam),(Xbox)' else '' end as preferred,
{_pick_sql(_SINGLE, 's')} as company, {_pick_sql(_SUBS, 's')} as only_services, {_pick_sql(_COMPANIES, 's')} as only_companies from o join p using (n, g)""",
    ),
    "follow_up_questions": (
        follow_up_questions,
        """select p_partkey, case p_partkey % 5 when 0 then case when p_partkey % 3 = 0 then 'two?' else 'one?|two?' end when 3 then case when p_partkey % 3 = 1 then 'a|b|d' else 'a|b|c' end else '' end as questions from part""",
    ),
    "sheet_progress": (
        sheet_progress,
        """select source, count(*) as total, count(quality) as done, sum(length(text))::bigint as tokens, max(case when length(text) > 100 then 101 else length(text) end)::bigint as longest from documents left join labels using (doc_id) group by source""",
    ),
}
