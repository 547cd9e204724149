"""Queries over sheets, contexts of answers, and indexes as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contexts as T
from ..operators import indexing as I
from ..operators import sheets as H
from ..tables import LINES_SQL, document_lines, ensure_checkpoint_dir, table, version_chain
from .version_queries import FACTS_SQL, _facts


def history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of history question can be asked about, of changes made from orders."""
    n = F.col("id")
    changes = _facts(spark, sf_dir).select(
        "path", (n % 97).alias("lineage"), "id", "version_date", F.format_string("제%d조#%d", n % 3, n % 2).alias("clause_id"), "change_type", (n % 100 / 100).alias("similarity"), F.expr("repeat('x', cast(id % 160 as int))").alias("text")
    )
    current = changes.where("id % 5 = 0").select("path", "lineage")
    return H.history_candidates(changes, current, changes.select("path", "version_date").distinct()).select("kind", "path", "lineage", "id", "version_date")


def question_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines and changes questions can be drawn from."""
    lines = document_lines(table(spark, sf_dir, "documents")).select("source", F.col("line").alias("text"))
    changes = _facts(spark, sf_dir).select("change_type", (F.col("id") % 100 / 100).alias("similarity"), F.expr("repeat('x', cast(id % 160 as int))").alias("text"))
    current, changed = H.question_candidates(lines, changes)
    return current.groupBy(F.lit("current").alias("kind")).agg(F.count("*").alias("n")).unionByName(changed.groupBy(F.col("change_type").alias("kind")).agg(F.count("*").alias("n")))


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents to label, sources in turn."""
    return H.label_sample(table(spark, sf_dir, "documents"), "source", ["doc_id"]).select("id", "doc_id", "source", "turn")


def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revised, removed and new lines as a reviewer sees them."""
    chain = version_chain(table(spark, sf_dir, "documents"))
    old, new = (chain.where(F.col("version_seq") == v).select("doc_id", "idx", F.col("line").alias(c)) for v, c in ((1, "old_text"), (3, "text")))
    met = old.join(new, ["doc_id", "idx"], "left").where("text is null or old_text <> text")
    kind = F.when(F.col("text").isNull(), "removed").otherwise("modified")
    rows = met.select("doc_id", "idx", kind.alias("change_type"), F.coalesce("text", "old_text").alias("text"), F.when(F.col("text").isNotNull(), F.col("old_text")).alias("old_text"))
    return H.review_rows(rows).select("doc_id", F.col("idx").cast("long").alias("idx"), "changed_words", F.md5("old_text").alias("old_text"), F.md5("new_text").alias("new_text"))


def version_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of two kinds of blocks for each customer: orders as versions of a document, and its first order as a statute."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.to_date("o_orderdate").alias("version_date"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    each = orders.groupBy("question", "version_date").agg(F.count("*").alias("changed"), F.min("status").alias("status"))
    versions = each.select("question", F.lit("D1").alias("tag"), F.when(F.col("question") % 2 == 0, "Terms").alias("title"), F.concat(F.lit("p"), "question").alias("path"), "version_date", F.when(F.col("status") == "F", F.date_add("version_date", 1)).alias("effective_date"), "changed")
    first = orders.groupBy("question").agg(F.min(F.struct("version_date", "key")).alias("o")).select("question", "o.*")
    laws = first.select(
        "question", F.lit("L1").alias("tag"), F.lit("표시ㆍ광고법").alias("law"), F.when(F.col("key") % 2 == 0, "법률").otherwise("시행령").alias("category"), F.lit("제1조").alias("article"), F.when(F.col("key") % 3 == 0, F.col("version_date")).alias("as_of"),
        F.when(F.col("key") % 5 > 0, F.col("version_date")).alias("effective"), F.when(F.col("key") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array()).cast("array<string>").alias("cited_by"), (F.col("key") % 4 == 0).alias("by_title"), F.lit("text").alias("text"),
    )
    return T.contexts([T.law_blocks(laws), T.version_blocks(versions)]).select("question", F.md5("context").alias("context"))


def version_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the versions that answers cite: lines of orders as citations of their parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    tag = F.concat(F.element_at(F.array(*map(F.lit, "CTHDL")), (F.col("supp") % 5 + 1).cast("int")), F.col("l_linenumber").cast("string"))
    cited = lines.select(F.col("l_orderkey").alias("question"), tag.alias("tag"), F.col("l_linenumber").alias("place"), (F.col("part") % 10).cast("string").alias("path"), F.concat(F.lit("doc "), F.col("part") % 10).alias("name"), F.lit("2020-01-01").alias("version_date"))
    latest = spark.range(0, 10, 3).select(F.col("id").cast("string").alias("path"), F.lit("2024-12-31").alias("latest_version"))
    return T.version_notes(cited, latest).select("question", F.md5("note").alias("note"))


def _entries(spark: SparkSession, sf_dir: str, revised: bool) -> DataFrame:
    lines = document_lines(table(spark, sf_dir, "documents")).where(F.col("idx") % (13 if revised else 11) != 0)
    text = F.when((F.col("idx") % 5 == 1) & F.lit(revised), F.concat("line", F.lit("."))).otherwise(F.col("line"))
    return lines.select(F.concat_ws("#", "doc_id", "idx").alias("id"), text.alias("embed"), F.substring(F.sha2(text, 256), 1, 16).alias("embed_hash"), text.alias("text"), F.create_map(F.lit("group"), F.col("source")).alias("metadata"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[1.0, float(len(t))] for t in texts]


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of lines, brought to revised lines: actions of both steps, and what the index then holds of each source."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    I.upsert(spark, _entries(spark, sf_dir, False), path, 0, _lengths)
    I.upsert(spark, _entries(spark, sf_dir, True), path, 1, _lengths)
    held = I.read_index(spark, path, 1)
    return held.groupBy(F.col("metadata")["group"].alias("source")).agg(F.count("*").alias("entries"), F.sum(F.col("vector")[1]).cast("long").alias("chars"))


def case_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as corrected cases of five releases."""
    k = F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("2020-01-01_"), (k % 6).cast("string")).alias("doc"), k.alias("nth"), F.concat(F.lit("  "), "p_name", F.lit("\n")).alias("before"), F.when(k % 3 == 0, "삭제").otherwise(F.concat(F.lit(" "), "p_name")).alias("after"), F.when(k % 2 == 0, "liability").alias("issue")
    )
    releases = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("number"), F.col("r_name").alias("title"), F.lit("t").alias("target"), F.lit(None).cast("string").alias("field"))
    m = F.col("metadata")
    return I.case_entries(pairs, releases).select("id", "embed_hash", m["title"].alias("title"), m["after"].alias("after"), m["issue"].alias("issue"), m["target"].alias("target"))


_GOOD = "case when change_type = 'modified' then id % 160 >= 80 and id % 100 / 100 < 0.95 else id % 160 >= 80 end"

QUERIES = {
    "history_candidates": (
        history_candidates,
        f"""with {FACTS_SQL}, c as (select *, id % 97 lineage, id % 3 article, {_GOOD} good from facts), e as (select path, lineage, count(*) n, count(distinct article) a, max((version_date, id)) filter (good) l from c group by path, lineage having bool_or(good))
select 'dated' as kind, path, lineage, id, version_date from c where good and change_type in ('modified', 'added') union all select 'undated', path, lineage, l[2], l[1] from e where n >= 2
union all select 'deleted', path, lineage, id, version_date from c where good and change_type = 'removed' and not exists (select 1 from facts f where f.path = c.path and f.id % 97 = c.lineage and f.id % 5 = 0) union all select 'renumbered', path, lineage, l[2], l[1] from e where a > 1
union all select 'doc', path, null, null, max(version_date) from facts group by path having count(distinct version_date) >= 3""",
    ),
    "question_pool": (
        question_pool,
        f"""with {LINES_SQL}, {FACTS_SQL} select 'current' as kind, count(*) as n from lines where length(line) between 80 and 3000 union all select change_type, count(*) from facts where (change_type <> 'modified' or id % 100 / 100 < 0.97) and id % 160 >= 60 group by change_type""",
    ),
    "label_sheet": (
        label_sheet,
        """with r as (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) turn from documents where length(text) between 40 and 1500), k as (select * from r order by turn, source limit 50) select row_number() over (order by turn, source) as id, doc_id, source, turn from k""",
    ),
    "review_sheet": (
        review_sheet,
        f"""with {LINES_SQL} select doc_id, idx, case when idx % 5 = 3 then '' else '''' || ''' → ''(rev)''' end as changed_words, md5(substring(line, 1, 1500)) as old_text, md5(case when idx % 5 = 3 then '' else substring(line || ' (rev)', 1, 1500) end) as new_text from lines where idx % 5 = 3 or idx % 7 = 2""",
    ),
    "version_contexts": (
        version_contexts,
        """with o as (select o_custkey question, o_orderdate::date d, o_orderkey key, o_orderstatus s from orders), e as (select question, d, count(*) c, min(s) s from o group by question, d), r as (select *, row_number() over (partition by question order by d) nth, count(*) over (partition by question) n from e),
v as (select question, '[D1] ' || case when question % 2 = 0 then 'Terms' else 'p' || question end || ' (p' || question || ') 개정 이력: 버전 ' || max(n) || '개, 최초 ' || min(d) || ', 마지막 수집본 ' || max(d) || chr(10)
|| string_agg('· ' || d || ' (' || case when nth = 1 then '최초 수집' else '조항 ' || c || '개 변경' end || case when s = 'F' then ', 시행 ' || (d + 1) else '' end || ')', chr(10) order by nth) filter (nth > n - 30) block from r group by question),
f as (select question, min((d, key)) x from o group by question), l as (select question, '[L1] 법령 표시·광고법' || case when x[2] % 2 = 0 then '' else ' 시행령' end || ' 제1조 (' || case when x[2] % 3 = 0 then '약관 버전 ' || x[1] || ' 당시' else '현행' end || ' 시행 중인 판, 시행 ' || case when x[2] % 5 > 0 then x[1]::varchar else '미상' end || ')' || chr(10)
|| case when x[2] % 2 = 0 then '(인용한 약관: a, b)' || chr(10) else '' end || case when x[2] % 4 = 0 then '(주의: 약관은 법령 이름만 들었고, 이 조문은 제목이 인용 문맥과 맞아 찾은 것이다)' || chr(10) else '' end || 'text' block from f)
select question, md5(v.block || chr(10) || chr(10) || '---' || chr(10) || chr(10) || l.block) as context from v join l using (question)""",
    ),
    "version_notes": (
        version_notes,
        """with c as (select l_orderkey question, l_linenumber place, min(l_suppkey) % 5 kind, min(l_partkey) % 10 path from lineitem group by l_orderkey, l_linenumber), e as (select question, path, min(place) place, bool_or(kind in (0, 3)) own from c where kind <> 4 group by question, path),
i as (select question, place, 'doc ' || path || case when path % 3 = 0 then ' 2024-12-31 버전' when own then ' 2020-01-01 버전' else '' end item from e), g as (select question, count(*) n, string_agg('· ' || item, chr(10) order by place, item) many, min(item) one from i group by question)
select question, md5(case when n = 1 then '※ 현재 제가 알고 있는 버전은 ' || one || '입니다. 이 조항은 최신이 아닐 수 있습니다.' else '※ 현재 제가 알고 있는 버전은 다음과 같습니다. 이 조항들은 최신이 아닐 수 있습니다.' || chr(10) || many end) as note from g""",
    ),
    "index_upsert": (
        index_upsert,
        f"""with {LINES_SQL} select source, count(*) as entries, sum(length(case when idx % 5 = 1 then line || '.' else line end))::bigint as chars from lines where idx % 13 <> 0 group by source""",
    ),
    "case_entries": (
        case_entries,
        """select '2020-01-01_' || p_partkey % 6 || '#' || p_partkey as id, substring(sha256(trim(p_name)), 1, 16) as embed_hash, coalesce(r_name, '') as title, case when p_partkey % 3 = 0 then '' else p_name end as after, case when p_partkey % 2 = 0 then 'liability' else '' end as issue,
case when r_name is null then '' else 't' end as target from part left join region on r_regionkey = p_partkey % 6""",
    ),
}
