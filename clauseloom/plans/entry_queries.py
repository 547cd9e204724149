"""Queries over index entries, catalogues, alerts and question candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import entries as N
from ..operators import history as H
from ..tables import LINES_SQL, table
from .text_queries import FULL_LINES_SQL, tokens_sql
from .version_queries import _HISTORY, _ORDER, FACTS_SQL, _facts

#: Aliases of services and what they name, for texts of the synthetic tables.
ALIASES = [("supplier", "supply"), ("customer", "sales"), ("supplier#1", "first"), ("the", "article"), ("der", "article")]


def piece_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clauses of their lines in pieces of 1,500 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("units"))
    found = N.pieces(docs, "doc_id", "units")
    return found.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).cast("long").alias("chars"))


def clause_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pieces of their document, with their neighbours and hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = docs.withColumn("piece", (F.col("n") + 1).cast("long")).withColumn("g", F.col("doc_id").cast("string"))
    made = N.entries(found, "doc_id", "g", ["piece"], F.concat(F.lit("["), "source", F.lit("]")), "line")
    return made.select("id", "embed_hash", "prev", "next", "vector")


def change_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).withColumn("clause", F.col("id") % 3).withColumn("month", F.date_format("version_date", "yyyy-MM"))
    made = N.change_entries(facts, "path", "clause", "month", "change_type", "id")
    text = N.change_text(F.concat(F.lit("("), "month", F.lit(")")), F.when(F.col("change_type") != "added", F.lit("old")), F.when(F.col("change_type") != "removed", F.col("score").cast("string")))
    return made.select(F.col("id").alias("entry"), F.length(text).cast("long").alias("chars"))


def service_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("ask "), "s_name", F.lit(" or the customers, the Customer")).alias("said"))
    return N.detect_services(said, "s_suppkey", "said", ALIASES).select("s_suppkey", F.array_join("services", ",").alias("services"))


def named_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    titles = docs.select("doc_id", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"))
    return N.named_document(items, "item_id", "text", titles, "doc_id", "title")


def company_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda s: F.concat_ws(":", s["lang"], s["n"].cast("string"))), ",")
    return each.groupBy("source").agg(F.sum("n").alias("documents"), kinds.alias("kinds"), F.max("latest").alias("latest"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which clauses became unfavourable, with the changes that did it, newest first."""
    scored = C.scored_history(_facts(spark, sf_dir), "path", _ORDER, "score").withColumn("flag", C.flag(F.col("change_type"), F.col("carried"), F.col("old_score")))
    return H.alerts(scored, ["path", "version_date"], "carried")


def qa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clauses to ask about, sources in turn: lines of 80 to 600 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where(F.length("line").between(80, 600))
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat_ws("#", "doc_id", "idx")), "doc_id", "idx"))
    return docs.withColumn("turn", turn.cast("long")).where("turn <= 40").orderBy("turn", "source").limit(40).select("source", "doc_id", F.col("idx").cast("long").alias("idx"), "turn")


def qa_history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of history questions that each path can be asked: changed more than once, removed last, quiet for a year."""
    facts = _facts(spark, sf_dir)
    each = facts.groupBy("path").agg(
        F.count("*").alias("changes"), F.countDistinct("change_type").alias("kinds"), F.max_by("change_type", F.struct("version_date", "id")).alias("last_kind"), F.min("version_date").alias("first"), F.max("version_date").alias("last")
    )
    kind = F.when(F.col("last_kind") == "removed", "deleted").when(F.col("changes") > 5, "multi_change").when(F.datediff("last", "first") > 365, "dated").otherwise("document")
    return each.groupBy(kind.alias("kind")).agg(F.count("*").alias("paths"), F.sum("changes").alias("changes"))


def ab_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to cut documents, 1,500 characters without and 750 with an overlap of 100, side by side for each source."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("source", F.length("text").alias("n"))
    cuts = F.array(F.struct(F.lit("a").alias("way"), F.ceil(F.col("n") / 1500).alias("chunks")), F.struct(F.lit("b").alias("way"), F.greatest(F.ceil((F.col("n") - 100) / 650), F.lit(1)).alias("chunks")))
    each = docs.select("source", F.explode(cuts).alias("c")).select("source", "c.*")
    wide = each.groupBy("source").pivot("way", ["a", "b"]).agg(F.sum("chunks").cast("long"))
    return wide.withColumn("more", F.col("b") - F.col("a"))


def version_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version date of each path that has changes of this kind, and whether that change is its newest."""
    facts = _facts(spark, sf_dir)
    newest = facts.groupBy("path").agg(F.max("version_date").alias("latest"))
    cited = facts.where("change_type = 'added'").groupBy("path").agg(F.max("version_date").alias("cited"))
    return cited.join(newest, "path").select("path", "cited", "latest", (F.col("cited") == F.col("latest")).alias("current"))


QUERIES = {
    "piece_packing": (piece_packing, None),
    "clause_entries": (
        clause_entries,
        f"""with {LINES_SQL}, i as (select doc_id, idx, doc_id || '::' || (idx + 1) as id, substring(sha256('[' || source || ']' || chr(10) || line), 1, 16) as embed_hash, line as text from lines),
k as (select *, len({FULL_LINES_SQL}) > 0 and len(list_filter({FULL_LINES_SQL}, lambda s: starts_with(s, '|'))) / len({FULL_LINES_SQL}) >= 0.8 l from i)
select id, embed_hash, lag(id) over w as prev, lead(id) over w as next, not coalesce(l, false) or sum(coalesce(l, false)::int) over (partition by doc_id order by idx rows between unbounded preceding and current row) <= 3 as vector from k window w as (partition by doc_id order by idx)""",
    ),
    "change_entries": (
        change_entries,
        f"""with {FACTS_SQL}, n as (select *, path || '::' || id % 3 || '::' || strftime(version_date, '%Y-%m') || '::' || change_type as name, strftime(version_date, '%Y-%m') m from facts), r as (select *, row_number() over (partition by name order by id) k from n)
select case when k > 1 then name || '#' || k else name end as entry, length('(' || m || ')' || case when change_type <> 'added' then chr(10) || '[before]' || chr(10) || 'old' else '' end || case when change_type <> 'removed' and score is not null then chr(10) || '[after]' || chr(10) || score::varchar else '' end) as chars from r""",
    ),
    "service_detection": (
        service_detection,
        """select s_suppkey, case when regexp_matches(lower(s_name), '(^|[^a-z0-9])supplier#1($|[^a-z0-9])') then 'first,sales,article' when regexp_matches(lower(s_name), '(^|[^a-z0-9])supplier($|[^a-z0-9])') then 'sales,supply,article' else 'sales,article' end as services from supplier""",
    ),
    "named_document": (
        named_document,
        f"""with t as (select doc_id, regexp_extract(text, '^([^\\n]*)', 1) title from documents), a as (select distinct item_id, unnest({tokens_sql('text')}) as term from benchmark), h as (select distinct doc_id, length(title) size, unnest({tokens_sql('title')}) as term from t),
s as (select item_id, doc_id, size, count(*) shared from a join h using (term) group by item_id, doc_id, size), r as (select *, row_number() over (partition by item_id order by shared desc, size, doc_id) n from s) select item_id, doc_id, shared from r where n = 1""",
    ),
    "company_catalogue": (
        company_catalogue,
        """with e as (select source, lang, count(*) n, max(doc_id) latest from documents group by source, lang) select source, sum(n)::bigint as documents, string_agg(lang || ':' || n, ',' order by lang) as kinds, max(latest) as latest from e group by source""",
    ),
    "alerts": (alerts, f"{_HISTORY} select path, version_date, string_agg(id::varchar, ',' order by id) as triggers, min(carried) as lowest from f where flag = 'became' group by path, version_date"),
    "qa_candidates": (
        qa_candidates,
        f"""with {LINES_SQL}, r as (select source, doc_id, idx, row_number() over (partition by source order by md5(doc_id || '#' || idx), doc_id, idx) turn from lines where length(line) between 80 and 600) select source, doc_id, idx, turn from r order by turn, source limit 40""",
    ),
    "qa_history_candidates": (
        qa_history_candidates,
        f"""with {FACTS_SQL}, e as (select path, count(*) changes, max_by(change_type, (version_date, id)) k, min(version_date) a, max(version_date) b from facts group by path)
select case when k = 'removed' then 'deleted' when changes > 5 then 'multi_change' when b - a > 365 then 'dated' else 'document' end as kind, count(*) as paths, sum(changes)::bigint as changes from e group by kind""",
    ),
    "ab_pivot": (
        ab_pivot,
        """with d as (select source, ceil(length(text) / 1500)::bigint a, greatest(ceil((length(text) - 100) / 650), 1)::bigint b from documents where length(text) > 0) select source, sum(a)::bigint as a, sum(b)::bigint as b, (sum(b) - sum(a))::bigint as more from d group by source""",
    ),
    "version_note": (
        version_note,
        f"""with {FACTS_SQL} select path, max(version_date) filter (change_type = 'added') as cited, max(version_date) as latest, max(version_date) filter (change_type = 'added') = max(version_date) as current from facts group by path having count(*) filter (change_type = 'added') > 0""",
    ),
}
