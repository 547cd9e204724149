"""Queries over links: cases, statutes, look-ups as of a date, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking as L
from ..operators.retrieval import vector_links
from ..tables import table

#: Similarity from which vectors of the synthetic tables count as linked; they lie further apart than real ones.
LEAST = 0.3


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of the vectors of query rows (cases) with all rows (clauses) but themselves, all from ``LEAST`` on once rounded."""
    vectors = table(spark, sf_dir, "embeddings")
    cases = vectors.where("vec_id % 50 = 0")
    found = vector_links(vectors, cases, LEAST - 0.001).where("vec_id <> query_id")
    return found.select(F.col("vec_id").alias("group"), F.col("query_id").alias("case_id"), F.round("similarity", 3).alias("similarity")).join(cases.select(F.col("vec_id").alias("case_id"), F.col("label").alias("release")), "case_id")


def case_links_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_links(_links(spark, sf_dir), "group", "case_id", "release", "similarity", LEAST)


def best_per_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _links(spark, sf_dir).where(F.col("similarity") >= LEAST)
    return kept.groupBy("release").agg(F.countDistinct("group").alias("groups"), F.max("similarity").alias("best")).select(F.col("release").cast("long").alias("release"), "groups", "best")


def law_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's latest sign-up that has come into effect, up to two days after it was made."""
    events = table(spark, sf_dir, "events")
    effective = F.timestamp_add("DAY", F.pmod("event_id", F.lit(3)), F.col("ts"))
    versions = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("promulgated"), effective.alias("effective"), F.col("event_id").alias("version"))
    questions = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("day"), F.col("event_id").alias("question"))
    return L.as_of(questions, versions, ["user_id"], "day", "question", "promulgated", "effective", "version").select("user_id", "question", "version")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    said = F.format_string("「민법」 제%d조 및 같은 법 제%d조의2, 전자상거래법 시행령 제%d조", F.col("o_custkey") % 40, F.col("o_orderkey") % 30, F.col("o_custkey") % 40)
    return L.citations(orders.select("o_orderkey", said.alias("said")), "o_orderkey", "said")


def law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("o_orderkey", F.col("nth").cast("long").alias("nth"), L.reference_key(F.col("law"), F.col("category"), F.col("article")).alias("ref"))


def law_citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).groupBy("law", "category").agg(F.count("*").alias("citations"), F.countDistinct("article").alias("articles"))


def pick_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as articles with their name's parts as title terms, against customers' names and segments of a nation's region."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("law"), F.col("n_nationkey").cast("long").alias("position"), F.col("n_name").alias("article"), F.split("n_name", "_").alias("terms"))
    parts = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    contexts = parts.select("s_suppkey", F.col("n_regionkey").alias("law"), F.concat("s_name", F.lit(" of "), "n_name").alias("context"))
    return L.pick_articles(contexts, "s_suppkey", "context", nations, ["law"])


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of 750 characters that overlap by 100, and each document's middle 200 characters."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"))
    start = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(650)))
    windows = docs.select("doc_id", "n", start.alias("a_start")).select("doc_id", "a_start", F.least(F.col("a_start") + 750, F.col("n")).alias("a_end"))
    middle = F.greatest(F.lit(0), F.floor(F.col("n") / 2).cast("int") - 100)
    return windows, docs.select("doc_id", middle.alias("b_start"), F.least(middle + 200, F.col("n")).alias("b_end"))


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, gold = _spans(spark, sf_dir)
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    found = L.overlaps(windows, gold, ["doc_id"], 1000).withColumn("shared", shared)
    return found.select("doc_id", F.col("a_start").cast("long").alias("a_start"), F.col("shared").cast("long").alias("shared"))


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document that its windows cover together."""
    windows, gold = _spans(spark, sf_dir)
    inside = L.overlaps(windows, gold, ["doc_id"], 1000).select("doc_id", F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"), (F.col("b_end") - F.col("b_start")).alias("size"))
    found = L.covered(inside.select("doc_id", "s", "e"), ["doc_id"], "s", "e").join(inside.select("doc_id", "size").distinct(), "doc_id")
    return found.select("doc_id", F.col("covered").cast("long").alias("covered"), F.round(F.col("covered") / F.col("size"), 6).alias("share"))


_COS = f"""with v as (select vec_id, label, embedding::double[] e from embeddings), p as (select d.vec_id "group", q.vec_id case_id, q.label release, round(list_cosine_similarity(q.e, d.e), 3) similarity from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id), k as (select * from p where similarity >= {LEAST})"""
_SPANS = """with d as (select doc_id, length(text) n from documents where length(text) > 0), w as (select doc_id, s a_start, least(s + 750, n) a_end from (select doc_id, n, unnest(generate_series(0, n - 1, 650)) s from d)),
g as (select doc_id, greatest(0, n // 2 - 100) b_start, least(greatest(0, n // 2 - 100) + 200, n) b_end from d), m as (select * from w join g using (doc_id) where a_start < b_end and b_start < a_end)"""
_CITED = """with c as (select o_orderkey, '민법' law, '법률' category, '제' || o_custkey % 40 || '조' article, 0 nth from orders union all select o_orderkey, '민법', '법률', '제' || o_orderkey % 30 || '조의2', 1 from orders
union all select o_orderkey, '전자상거래법', '시행령', '제' || o_custkey % 40 || '조', 2 from orders)"""

QUERIES = {
    "case_links_top3": (
        case_links_top3,
        f"""{_COS}, f as (select *, row_number() over (partition by "group", release order by similarity desc, case_id) n from k), r as (select "group", case_id, similarity, row_number() over (partition by "group" order by similarity desc, case_id) rank from f where n = 1)
select "group", case_id, similarity, rank from r where rank <= 3""",
    ),
    "best_per_release": (best_per_release, f"""{_COS} select release::bigint as release, count(distinct "group") as groups, max(similarity) as best from k group by release"""),
    "law_as_of": (
        law_as_of,
        """with v as (select user_id, ts p, event_id v, ts + to_days((event_id % 3)::int) e from events where event_type = 'signup'), q as (select user_id, ts d, event_id question from events where event_type = 'purchase')
select q.user_id, question, max_by(v, (p, v)) as version from q left join v on v.user_id = q.user_id and v.p <= q.d and v.e <= q.d group by q.user_id, question""",
    ),
    "law_citations": (law_citations, f"{_CITED} select o_orderkey, nth, law || '/' || category || '/' || article as ref from c"),
    "law_citation_counts": (law_citation_counts, f"{_CITED} select law, category, count(*) as citations, count(distinct article) as articles from c group by law, category"),
    "pick_articles": (
        pick_articles,
        """with a as (select n_regionkey law, n_nationkey::bigint as position, n_name article, string_split(n_name, '_') terms from nation), c as (select s_suppkey, n_regionkey law, regexp_replace(s_name || ' of ' || n_name, '\\s+', '', 'g') ctx from supplier join nation on s_nationkey = n_nationkey),
h as (select s_suppkey, article, position, terms, list_filter(terms, lambda t: contains(ctx, t)) hit from c join a using (law)), s as (select *, coalesce(list_sum(list_transform(hit, lambda t: length(t))), 0)::bigint score from h),
r as (select s_suppkey, article, score, row_number() over (partition by s_suppkey order by score desc, len(hit) / len(terms) desc, position) rank from s where score >= 3) select * from r where rank <= 2""",
    ),
    "span_overlap": (span_overlap, f"{_SPANS} select doc_id, a_start, least(a_end, b_end) - greatest(a_start, b_start) as shared from m"),
    "span_coverage": (
        span_coverage,
        f"""{_SPANS}, i as (select doc_id, greatest(a_start, b_start) s, least(a_end, b_end) e, b_end - b_start size from m), o as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) before from i)
select doc_id, sum(greatest(0, e - greatest(s, coalesce(before, s))))::bigint as covered, round(sum(greatest(0, e - greatest(s, coalesce(before, s)))) / max(size), 6) as share from o group by doc_id""",
    ),
}
