"""Queries over whole flows: scans of versions, readable changes, routed searches, statutes, spans, evidence of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import chunking as K
from ..operators import retrieval as R
from ..operators import scan as X
from ..operators import scoring as S
from ..operators import search as P
from ..operators import statutes as L
from ..operators import views as W
from ..tables import CHAIN_SQL, stored, table, version_chain
from .retrieval_queries import _BM25
from .scoring_queries import CUES
from .text_queries import match_key_sql

#: Names of statutes and what stands for them.
STATUTES = {"표시ㆍ광고의공정화에관한법률": "표시ㆍ광고의공정화에관한법률", "표시광고법": "표시ㆍ광고의공정화에관한법률", "민법": "민법", "전자상거래법": "전자상거래등에서의소비자보호에관한법률"}


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions of each document as Markdown, each line an article of its own."""
    docs = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def body(version: int) -> Column:
        """As :func:`version_chain` has it, of all rows of a document."""

        def whole(line: Column, idx: Column) -> Column:
            line = F.when(idx % 7 == 2, F.concat(line, F.lit(" (rev)"))).otherwise(line) if version > 2 else line
            return F.concat(F.lit("### 제"), (idx + 1).cast("string"), F.lit("조 (T"), idx.cast("string"), F.lit(")\n"), F.regexp_replace(line, r"\s+", " "), F.lit(" of the terms"))

        lines = F.flatten(F.transform("texts", lambda text: F.transform(F.split(text, "\n"), lambda line, idx: F.struct(idx.alias("idx"), whole(line, idx).alias("t")))))
        kept = lines if version == 1 else F.filter(lines, lambda s: s["idx"] % 5 != 3)
        return F.array_join(F.transform(F.array_sort(kept), lambda s: s["t"]), "\n")

    each = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(v).alias("version_seq"), body(v).alias("body")) for v in range(1, 5)))).alias("v"))
    bodies = each.select("doc_id", "v.version_seq", "v.body")
    day = F.make_date(F.lit(2020), F.col("version_seq"), F.lit(1))
    effective = F.when(F.col("version_seq") > 1, F.date_add(day, (F.col("doc_id") % 3).cast("int")))
    return bodies.select(F.col("doc_id").cast("string").alias("path"), "version_seq", day.alias("version_date"), effective.alias("effective_date"), "body")


def _score(units: DataFrame) -> DataFrame:
    return S.score_units(units, "text", CUES).select("*", "score.favor_score").drop("score")


def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a scan, by document, version and kind: how many, of how many lineages, with how many changed units, and until when one can act."""
    records, _ = X.scan(_versions(spark, sf_dir), _score)
    return records.groupBy("path", F.col("seq").cast("long").alias("seq"), "change_type").agg(
        F.count("*").alias("records"), F.countDistinct("lineage").alias("lineages"), F.sum(F.size("unit_changes")).alias("units"), F.max("action_deadline").alias("deadline")
    )


def scan_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each document's last version that said something new, and how many of them go back to its first."""
    _, current = X.scan(_versions(spark, sf_dir), _score)
    return current.groupBy("path").agg(F.count("*").alias("clauses"), F.count(F.when(F.col("lineage").endswith("2020-01-01"), 1)).alias("first"), F.max("seq").cast("long").alias("seq"))


def change_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revised line as text with its change marked, and whether a change is seen."""
    chain = version_chain(table(spark, sf_dir, "documents"))
    old, new = (chain.where(F.col("version_seq") == v).select("doc_id", "idx", F.col("line").alias(c)) for v, c in ((2, "old"), (3, "new")))
    met = old.join(new, ["doc_id", "idx"]).where("old <> new or idx % 7 = 3").withColumn("ops", W.lossless_diff(F.col("old"), F.col("new")))
    return met.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5(W.diff_text(F.col("old"), F.col("new"))).alias("shown"), W.is_changed(F.col("ops")).alias("changed"))


def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions: odd ones of English documents alone, the others of all sources in turn, with one source boosted."""
    items = table(spark, sf_dir, "benchmark")
    none = F.lit(None).cast("array<string>")
    asked = items.select(
        F.col("item_id").alias("question"), none.alias("want_company"), none.alias("want_service"), F.when(F.col("item_id") % 2 == 1, F.array(F.lit("en"))).alias("want_type"), F.array(F.lit("9")).alias("not_paths"), F.array(F.lit("src1")).alias("boost_paths")
    )
    source = F.col("source")
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.col("doc_id").cast("string").alias("group"), source.alias("company"), source.alias("service"), F.col("lang").alias("doc_type"), source.alias("path"))
    # conditions look at these columns alone, so that a question's rankings are each of some of their combinations
    kinds = table(spark, sf_dir, "documents").select(F.to_json(F.struct("lang", "source")).alias("kind"), source.alias("company"), source.alias("service"), F.col("lang").alias("doc_type"), source.alias("path")).distinct()
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question").join(P.routes(asked, kinds, "kind").withColumnRenamed("question", "item_id"), "item_id")
    best = R.bm25_top(table(spark, sf_dir, "documents"), items, "doc_id", "text", "item_id", "question", R.CANDIDATES, by=("lang", "source"), among="among")
    scores = best.select(F.col("item_id").alias("question"), F.col("doc_id").alias("entry"), "score")
    return P.routed_search(asked, entries, [(scores, 1.0)], 10).select("question", "entry", "rank", "diverse")


def history_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as histories of their lines: those in the quarter that a customer's question names, if there are any."""
    orders = table(spark, sf_dir, "orders")
    found = orders.select((F.col("o_custkey") % 50).alias("question"), (F.col("o_custkey") % 7).cast("string").alias("path"), F.col("o_orderkey").alias("lineage"), F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")).alias("rank"))
    changes = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", (F.col("o_custkey") % 7).cast("string").alias("path")), F.col("l_orderkey") == F.col("o_orderkey"))
    changes = changes.select("path", F.col("l_orderkey").alias("lineage"), F.col("l_linenumber").cast("long").alias("id"), F.to_date("l_shipdate").alias("version_date"))
    n = F.col("question")
    asked = found.select("question").distinct().select(
        n, F.when(n % 5 == 0, "current").otherwise("clause_history").alias("intent"), F.when(n % 3 == 1, F.lit("1995-01-01")).cast("date").alias("date_from"), F.when(n % 3 == 1, F.lit("1996-12-31")).cast("date").alias("date_to"),
        F.when(n % 3 == 2, "07").alias("month_day"),
    )
    told = P.timelines(found, changes, asked)
    return told.select("question", "lineage", "total", "date_matched", F.array_join(F.transform("changes", lambda x: x.cast("string")), ",").alias("changes"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as graded evidence of their conversation."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", F.col("turn").alias("key"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") % 4 > 0, (F.col("turn") * 37) % 100 / 100).alias("grade"))


def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir).withColumn("grade", F.coalesce("grade", F.lit(0.0))).withColumn("size", F.length("text"))
    return P.context_fit(rows, "conv_id", "grade", "size", 500).select("conv_id", "key", F.col("used").cast("long").alias("used"))


def live_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.live_evidence(_said(spark, sf_dir), "conv_id", 3).select("conv_id", "key", F.md5("snippet").alias("snippet"), "grade", "kept")


def date_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as changes to choose from."""
    lines = table(spark, sf_dir, "lineitem")
    clause = F.concat(F.lit("제"), (F.col("l_suppkey") % 3).cast("string"), F.lit("조#2"))
    rows = lines.select(F.col("l_orderkey").alias("question"), (F.col("l_linenumber") % 2).alias("item"), F.floor(F.col("l_linenumber") / 2).alias("nth"), F.col("l_linenumber").cast("long").alias("id"), F.to_date("l_shipdate").alias("version_date"), F.col("l_returnflag").alias("path"), clause.alias("clause_id"))
    return P.date_choices(rows, "question", 3).select("question", "id", "place")


def statute_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as statutes whose articles are nations."""
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.lit("##### 제"), F.col("n_nationkey").cast("string"), F.lit("조 ("), "n_name", F.lit(")\n"), "n_name", F.lit(" has rules.\n\nand more")).alias("t"))
    bodies = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "t"))), lambda s: s["t"]), "\n").alias("b"))
    raw = bodies.select("n_regionkey", F.concat(F.lit("---\n제목: 법\n시행일자: 2020-01-01\n---\n## 제1장 총칙\nlost line\n"), "b").alias("raw"))
    found = L.statute_articles(raw, ["n_regionkey"], "raw")
    meta = raw.select("n_regionkey", L.statute_meta(F.col("raw"))["시행일자"].alias("effective"))
    return found.join(meta, "n_regionkey").select("n_regionkey", "article", "title", "part", F.md5("text").alias("text"), "effective")


def named_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes that orders cite by name: with other spaces, as a short name, as a decree, and with an article, which does not count."""
    by = F.col("o_orderkey")
    said = F.element_at(F.array(*map(F.lit, ("「표시·광고의 공정화에 관한 법률」에 따릅니다", "전자상거래법 시행령 및 민법에 따릅니다", "민법 제3조에 따릅니다", "표시광고법과 표시광고법", "nothing"))), (by % 5 + 1).cast("int"))
    return L.named_statutes(table(spark, sf_dir, "orders").select(by, said.alias("said")), "o_orderkey", "said", STATUTES).select("o_orderkey", "law", "category")


def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every benchmark text, written as one, in documents that may put white space anywhere inside them."""
    words = [F.regexp_extract("text", r"^(\S+)\s+(\S+)", n) for n in (1, 2)]
    names = table(spark, sf_dir, "benchmark").select(F.concat(*words).alias("name")).where("name <> ''").distinct()
    found = L.find_names(table(spark, sf_dir, "documents"), "doc_id", "text", (r[0] for r in names.toLocalIterator()))
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("places"))


def cited_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose titles' words stand around the name of their statute."""
    parts = table(spark, sf_dir, "part")
    titles = [("제17조", "청약철회등"), ("제18조", "청약철회등의 효과"), ("제1조", "목적"), ("제5조", "광고에 관한 사항")]
    articles = parts.sparkSession.createDataFrame([("민법", "법률", a, n, t) for n, (a, t) in enumerate(titles)], "law string, category string, article string, position int, title string")
    context = F.element_at(F.array(*map(F.lit, ("청약 철회는", "광고에 대한 청약철회", "목적", "없음"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    named = parts.select("p_partkey", F.lit("민법").alias("law"), F.lit("법률").alias("category"), context.alias("context"))
    return L.resolve_names(named, "p_partkey", articles).select("p_partkey", "article", "score", "rank")


def chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to cut documents: nothing is lost, and no span says anything but its text."""
    docs = table(spark, sf_dir, "documents")
    return K.structure(docs, K.chunk(docs, "doc_id", "text"), "doc_id", "text")


def chunk_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways on each document's own middle line as the question, spans in the order of the terms they share with it: means by source."""
    docs = table(spark, sf_dir, "documents")
    chunks = K.chunk(docs, "doc_id", "text")
    asked = stored(K.probes(docs, "doc_id", "text"))
    shared = F.size(F.array_intersect(tokens(F.col("question")), tokens(F.col("text"))))
    scored = chunks.join(asked.select("doc_id", "question"), "doc_id").withColumn("shared", shared)
    rank = F.row_number().over(Window.partitionBy("doc_id", "way").orderBy(F.desc("shared"), "start"))
    # both are read several times
    ranked = stored(scored.select(F.col("doc_id").alias("asked"), "way", rank.alias("rank"), "doc_id", "start", "end").where(F.col("rank") <= K.TOP))
    gold = asked.select(F.col("doc_id").alias("asked"), "doc_id", F.array(F.struct("start", "end")).alias("spans"))
    results = K.evaluate(ranked, gold, "asked", "doc_id", ["way"]).join(docs.select(F.col("doc_id").alias("asked"), "source"), "asked")
    return K.side_by_side(results, docs, "source", "way", ["A", "B"], ["hit1", "hit5", "mrr5", "coverage"])


def ab_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five spans of all documents that keywords rank highest in each way, for the middle line of every fiftieth document."""
    docs = table(spark, sf_dir, "documents")
    asked = K.probes(docs.where("doc_id % 50 = 0"), "doc_id", "text").select(F.col("doc_id").alias("asked"), "question")
    return K.search_ways(K.chunk(docs, "doc_id", "text"), asked, "doc_id", "asked", "question")


def ab_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well both ways find the line that was asked for among the spans of all documents: means by source of the document asked about."""
    docs = table(spark, sf_dir, "documents")
    asked = K.probes(docs.where("doc_id % 50 = 0"), "doc_id", "text")
    gold = asked.select(F.col("doc_id").alias("asked"), "doc_id", F.array(F.struct("start", "end")).alias("spans"))
    results = K.evaluate(ab_spans(spark, sf_dir), gold, "asked", "doc_id", ["way"]).join(docs.select(F.col("doc_id").alias("asked"), "source"), "asked")
    return K.side_by_side(results, docs, "source", "way", ["A", "B"], ["hit1", "hit5", "mrr5", "coverage"])


def long_unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: scores of long ones by windows of 800 characters that say what they continue."""
    docs = table(spark, sf_dir, "documents")
    found = S.score_long_units(docs, "doc_id", "text", CUES, 800)
    return found.select("doc_id", "favor_score", "favor_confidence", F.size(F.coalesce("windows", F.array().cast(found.schema["windows"].dataType))).cast("long").alias("windows"))


_KEY = match_key_sql("(regexp_replace(line, '\\s+', ' ', 'g') || ' of the terms')")
_NAMED = "(values (0, '표시ㆍ광고의공정화에관한법률', '법률'), (1, '전자상거래등에서의소비자보호에관한법률', '시행령'), (1, '민법', '법률'), (3, '표시ㆍ광고의공정화에관한법률', '법률')) n(k, law, category)"

QUERIES = {
    "scan_records": (
        scan_records,
        f"""with {CHAIN_SQL}, c as (select doc_id::varchar as path, version_seq seq, idx, {_KEY} key, (date '2020-01-01' + to_months((version_seq - 1)::int))::date d, doc_id % 3 late from chain where version_seq < 4),
v as (select path, seq, count(*) n, max(late) late from c group by path, seq),
r as (select path, 1 as seq, 'initial' as change_type, n as records, 0 as units, null as deadline from v where seq = 1
union all select v.path, 2, 'removed', (select count(*) from c where c.path = v.path and c.seq = 1 and c.idx % 5 = 3),
(select count(*) from c where c.path = v.path and c.seq = 1 and c.idx % 5 = 3 and c.key not in (select k.key from c k where k.path = v.path and k.seq = 2)), case when late > 0 then (date '2020-02-01' + late::int - 1)::date end from v where seq = 2
union all select v.path, case when exists (select 1 from c where c.path = v.path and c.seq = 1 and c.idx % 5 = 3) then 3 else 2 end, 'modified', (select count(*) from c where c.path = v.path and c.seq = 3 and c.idx % 7 = 2), null, case when late > 0 then (date '2020-03-01' + late::int - 1)::date end from v where seq = 3)
select path, seq::bigint as seq, change_type, records, records as lineages, coalesce(units, records)::bigint as units, deadline from r where records > 0""",
    ),
    "scan_current": (
        scan_current,
        f"""with {CHAIN_SQL}, c as (select doc_id::varchar as path, idx, version_seq from chain) select path, count(*) filter (version_seq = 3) as clauses, count(*) filter (version_seq = 3) as first,
(1 + (bool_or(version_seq = 1 and idx % 5 = 3))::int + (bool_or(version_seq = 3 and idx % 7 = 2))::int)::bigint as seq from c group by path having count(*) filter (version_seq = 3) > 0""",
    ),
    "change_views": (
        change_views,
        f"""with {CHAIN_SQL}, b as (select a.doc_id, a.idx, a.line old_line, b.line new_line from chain a join chain b using (doc_id, idx) where a.version_seq = 2 and b.version_seq = 3 and (a.line <> b.line or idx % 7 = 3)),
e as (select *, regexp_replace(old_line, '\\s+$', '') solid, old_line <> new_line changed from b), w as (select *, length(solid) n, substring(old_line, length(solid) + 1) tail from e)
select doc_id, idx, md5(case when not changed then case when length(old_line) >= 160 then '(…' || length(old_line) || '자 같음…)' else old_line end when length(old_line) + length(new_line) > 4000 then '[-' || old_line || '-]{{+' || new_line || '+}}' else case when n >= 160 and n - 60 >= 80 then '(…' || (n - 60) || '자 같음…)' || right(solid, 60) else solid end
|| case when tail <> '' then '[-' || tail || '-]' else '' end || '{{+' || tail || ' (rev)+}}' end) as shown, changed from w""",
    ),
    "routed_search": (
        routed_search,
        f"""{_BM25}, m as (select item_id, b.doc_id, score, source, item_id % 2 = 0 as diverse from b join documents d on d.doc_id = b.doc_id where item_id % 2 = 0 or b.lang = 'en'),
plain as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from m), boosted as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from m where source = 'src1'),
u as (select item_id, doc_id, source, diverse, 1.0::double / (60 + rank) part, 0 run, rank from plain where rank <= 50 union all select item_id, doc_id, source, diverse, 1.0::double / (60 + rank), 1, rank from boosted where rank <= 50),
sums as (select item_id, doc_id, source, diverse, sum(part) part, min((run, rank)) seen from u group by all), fused as (select item_id, doc_id, source, diverse, row_number() over (partition by item_id order by round(part, 12) desc, seen) rank from sums),
turns as (select *, row_number() over (partition by item_id, source order by rank) nth, min(rank) over (partition by item_id, source) best from fused where diverse)
select item_id as question, doc_id as entry, rank, diverse from fused where not diverse and rank <= 10 union all select item_id, doc_id, row_number() over (partition by item_id order by best, rank), diverse from turns where nth <= 2""",
    ),
    "history_timelines": (
        history_timelines,
        """with f as (select o_custkey % 50 question, o_custkey % 7 path, o_orderkey lineage, row_number() over (partition by o_custkey % 50 order by o_orderkey) rank from orders),
m as (select question, lineage, l_linenumber id, l_shipdate::date d, question % 3 = 1 and l_shipdate::date between date '1995-01-01' and date '1996-12-31' or question % 3 = 2 and month(l_shipdate) = 7 or question % 3 = 0 inside from f join lineitem on l_orderkey = lineage where rank <= 3 and question % 5 <> 0)
select question, lineage, count(*) as total, bool_or(inside) as date_matched, coalesce(string_agg(id::varchar, ',' order by d, id) filter (inside), string_agg(id::varchar, ',' order by d, id)) as changes from m group by question, lineage""",
    ),
    "context_fit": (
        context_fit,
        """with r as (select conv_id, turn, length(coalesce(text, '')) size, case when turn % 4 > 0 then (turn * 37) % 100 / 100 else 0 end g from conversations), u as (select *, row_number() over w place, sum(size + 7) over (w rows between unbounded preceding and current row) - 7 used from r window w as (partition by conv_id order by g desc, turn))
select conv_id, turn as key, least(used, 500)::bigint as used from u where used <= 500 or place = 1""",
    ),
    "live_evidence": (
        live_evidence,
        """with r as (select conv_id, turn, substring(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 140) s, case when turn % 4 > 0 then (turn * 37) % 100 / 100 end g from conversations),
u as (select *, count(*) over (partition by conv_id) n, row_number() over (partition by conv_id order by coalesce(g, 0) desc, turn) best from r) select conv_id, turn as key, md5(s) as snippet, round(g, 2) as grade, g >= 0.5 as kept from u where n <= 3 or best <= 3""",
    ),
    "date_choices": (
        date_choices,
        """with r as (select l_orderkey question, l_linenumber % 2 item, l_linenumber // 2 nth, l_linenumber::bigint id, l_shipdate::date d, l_returnflag path, l_suppkey % 3 clause from lineitem), t as (select *, row_number() over (partition by question, d, path, clause order by nth, item, id) turn from r),
k as (select *, row_number() over (partition by question order by nth, item, id, d, path, clause) rank from t where turn = 1), o as (select *, count(*) over (partition by question) n from k where rank <= 3) select question, id, row_number() over (partition by question order by d desc, rank) as place from o where n >= 2""",
    ),
    "statute_articles": (
        statute_articles,
        """select n_regionkey, '제' || n_nationkey || '조' as article, n_name as title, '제1장 총칙' as part, md5('제' || n_nationkey || '조 (' || n_name || ')' || chr(10) || n_name || ' has rules.' || chr(10) || chr(10) || 'and more') as text, '2020-01-01' as effective from nation""",
    ),
    "named_statutes": (named_statutes, f"select o_orderkey, law, category from orders join {_NAMED} on k = o_orderkey % 5"),
    "names_in_documents": (
        names_in_documents,
        """with n as (select distinct regexp_extract(text, '^(\\S+)\\s+(\\S+)', 1) || regexp_extract(text, '^(\\S+)\\s+(\\S+)', 2) as name from benchmark), d as (select doc_id, regexp_replace(text, '\\s+', '', 'g') s from documents)
select doc_id, name, (length(s) - length(replace(s, name, ''))) // length(name) as places from d join n on name <> '' and contains(s, name)""",
    ),
    "cited_titles": (
        cited_titles,
        """select p_partkey, article, score::bigint as score, rank::bigint as rank from part join (values (0, '제17조', 4, 1), (0, '제18조', 4, 2), (1, '제17조', 4, 1), (1, '제18조', 4, 2)) v(k, article, score, rank) on k = p_partkey % 4""",
    ),
    "chunk_structure": (chunk_structure, None),
    "chunk_comparison": (chunk_comparison, None),
    "ab_spans": (ab_spans, None),
    "ab_search": (ab_search, None),
    "long_unit_scores": (long_unit_scores, None),
}
