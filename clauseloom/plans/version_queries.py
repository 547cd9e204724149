"""Queries over versions, changes and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import changes as C
from ..operators import history as H
from ..operators import versions as V
from ..operators import views as W
from ..operators.history_store import write_store
from ..tables import CHAIN_SQL, LINES_SQL, ensure_checkpoint_dir, stored, table, version_chain
from .text_queries import match_key_sql


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_chain(table(spark, sf_dir, "documents"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of clauses: path, version_date, id, change_type, score (-2 to 2; null where the status is P)."""
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "added").when(F.col("o_orderpriority").startswith("5"), "removed").otherwise("modified")
    score = F.round(F.pmod(F.floor(F.col("o_totalprice")).cast("long"), F.lit(401)) / 100 - 2, 2)
    return orders.select(
        F.col("o_custkey").alias("path"), F.to_date("o_orderdate").alias("version_date"), F.col("o_orderkey").alias("id"), kind.alias("change_type"), F.when(F.col("o_orderstatus") != "P", score).alias("score")
    )


FACTS_SQL = """facts as (select o_custkey as path, o_orderdate::date as version_date, o_orderkey as id,
case when o_orderpriority like '1%' then 'added' when o_orderpriority like '5%' then 'removed' else 'modified' end as change_type,
case when o_orderstatus <> 'P' then round(floor(o_totalprice)::bigint % 401 / 100 - 2, 2) end as score from orders)"""
_ORDER = ["version_date", "id"]


def version_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.version_bodies(_chain(spark, sf_dir))
    return found.select("doc_id", F.col("version_seq").cast("long").alias("version_seq"), "n_clauses", "body_hash")


def hash_gate_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = V.changed_versions(V.version_bodies(_chain(spark, sf_dir)))
    return gated.groupBy(F.col("version_seq").cast("long").alias("version_seq")).agg(F.count("*").alias("versions"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))


def data_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return V.data_cards(orders, F.col("o_custkey"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")))


def version_layer_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    orders = table(spark, sf_dir, "orders").join(ships, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", dates.action_deadline(F.to_date("o_orderdate"), F.to_date("ship")).alias("action_deadline"))


def unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chain(spark, sf_dir).where("version_seq = 1")
    only = lines.groupBy("doc_id", F.md5("line").alias("title")).agg(F.count("*").alias("n"), F.min("idx").cast("long").alias("idx"))
    return only.where("n = 1").select("doc_id", "title", "idx")


def exact_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _chain(spark, sf_dir).select("doc_id", "version_seq", F.sha2(F.regexp_replace("line", r"\s+", ""), 256).alias("key"))
    found = C.exact_diff(keyed)
    return found.select("doc_id", F.col("version_seq").cast("long").alias("version_seq"), "same", "removed", "added")


def clause_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full diff of consecutive versions with modified and moved clauses; counts by version and kind."""
    chain = version_chain(table(spark, sf_dir, "documents"), text.match_key).select("doc_id", "version_seq", "idx", F.col("line").alias("key"), F.lit("").alias("title"))
    return C.clause_changes(chain).groupBy("version_seq", "change_type").agg(F.count("*").alias("changes"), F.round(F.avg("similarity"), 6).alias("similarity"))


def moved_unit_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _chain(spark, sf_dir).where(F.col("version_seq").isin(2, 3))
    chain = stored(kept.select("doc_id", "version_seq", "idx", F.md5(text.match_key(F.col("line"))).alias("key")))  # read six times
    old, new = (chain.where(F.col("version_seq") == v).select("doc_id", "idx", "key") for v in (2, 3))
    gone = old.join(new.select("doc_id", "idx", "key"), ["doc_id", "idx", "key"], "left_anti")
    come = new.join(old.select("doc_id", "idx", "key"), ["doc_id", "idx", "key"], "left_anti")
    removed, added = C.moved_units(gone, come, old.select("doc_id", "key").distinct(), new.select("doc_id", "key").distinct(), ["doc_id", "key"])
    return removed.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("removed")).unionByName(added.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("added")))


def lineage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order continues the one before it; the first names the lineage."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    node = F.concat_ws("@", "l_orderkey", "l_linenumber")
    edges = items.select("l_orderkey", node.alias("node"), F.lag(node).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("before"))
    return V.chain_roots(edges.select("node", "before")).select("node", F.col("root").alias("lineage"))


def lineage_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of each clause by its key: its first version and place in the document."""
    chain = version_chain(table(spark, sf_dir, "documents"), lambda line: F.unhex(F.md5(text.match_key(line))))
    return V.key_lineages(chain.withColumnRenamed("line", "key"), "doc_id", "version_seq", "idx", "key").select(
        "doc_id", F.concat(F.col("first.idx").cast("string"), F.lit("@"), F.col("first.version_seq").cast("string")).alias("lineage"), "versions"
    )


def score_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scored_history(_facts(spark, sf_dir), "path", _ORDER, "score").select("id", "carried")


def score_delta_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = C.scored_history(_facts(spark, sf_dir), "path", _ORDER, "score")
    return scored.select("id", "score_delta", C.flag(F.col("change_type"), F.col("carried"), F.col("old_score")).alias("flag"))


def became_unfavorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag_counts(spark, sf_dir, "became")


def removed_unfavorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag_counts(spark, sf_dir, "removed")


def _flag_counts(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    scored = C.scored_history(_facts(spark, sf_dir), "path", _ORDER, "score")
    return H.flagged(scored.withColumn("flag", C.flag(F.col("change_type"), F.col("carried"), F.col("old_score"))), flag, "carried")


def history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.versions_of(_facts(spark, sf_dir))


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return H.stats({"changes": facts, "versions": facts.select("path", "version_date").distinct(), "documents": facts.select("path").distinct()})


def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of 1997 with their place in the path's timeline; paths without one in the range keep all theirs."""
    inside = F.col("version_date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return H.timeline(_facts(spark, sf_dir), ["path"], _ORDER, inside).select("path", "id", "place", "date_matched")


def changes_between_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.newest(H.changes_between(_facts(spark, sf_dir), "1998-01-01", "1998-06-30"), 50).select("id", "path", "version_date", "change_type")


def month_day_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.changes_between(_facts(spark, sf_dir), month_day="07-25").select("id", "path", "version_date")


def latest_by_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_of(_facts(spark, sf_dir), ["path"])


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as a store in buckets: for every customer's tenth lineage how many changes its timeline has, and the newest of them."""
    ensure_checkpoint_dir(spark)
    facts = _facts(spark, sf_dir).withColumn("lineage", F.col("id") % 20)
    name = f"history_{uuid.uuid4().hex}"
    store = write_store(facts, facts.select("path", "lineage", "id"), name, f"{spark.sparkContext.getCheckpointDir()}/{name}", 16)
    asked = facts.where("lineage = 10").select("path", "lineage")
    found = store.timelines(asked).groupBy("path", "lineage").agg(F.count("*").alias("changes"))
    return found.join(store.latest(), ["path", "lineage"]).select("path", "changes", F.col("id").alias("newest"), "version_date")


def timeline_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.head_and_tail(_facts(spark, sf_dir), "path", _ORDER).select("path", "id", "version_date")


def last_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_versions(_facts(spark, sf_dir))


def word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word operations between each revised line and the line before it, equal runs folded."""
    chain = _chain(spark, sf_dir)
    old, new = (chain.where(F.col("version_seq") == v).select("doc_id", "idx", F.col("line").alias(c)) for v, c in ((2, "old"), (3, "new")))
    ops = C.word_diff(F.col("old"), F.col("new"))
    met = old.join(new, ["doc_id", "idx"]).where("old <> new").withColumn("ops", W.fold(ops))
    inserted = F.filter("ops", lambda o: o["kind"] == "ins")
    return met.select("doc_id", F.col("idx").cast("long").alias("idx"), F.array_join(F.transform(inserted, lambda o: o["text"]), " ").alias("inserted"), F.exists("ops", lambda o: o["kind"] == "del").alias("deleted"))


_HISTORY = f"""with {FACTS_SQL}, c as (select *, last_value(score ignore nulls) over (partition by path order by version_date, id rows between unbounded preceding and current row) as carried from facts),
h as (select *, lag(carried) over (partition by path order by version_date, id) as old_score from c),
f as (select *, round(carried - old_score, 3) as score_delta, case when change_type = 'added' and carried <= -0.7 then 'became' when change_type = 'modified' and round(carried - old_score, 3) <= -0.5 then 'became' when change_type = 'removed' and old_score <= -0.7 then 'removed' end as flag from h)"""
_FLAGGED = "select path, count(*) as changes, max(version_date) as latest, min(carried) as lowest from f where flag = '{}' group by path"
_KEYED = f"with {CHAIN_SQL}, k as (select doc_id, version_seq, idx, {match_key_sql('line')} as key from chain)"

QUERIES = {
    "version_bodies": (version_bodies, f"with {CHAIN_SQL} select doc_id, version_seq, count(*) as n_clauses, sha256(string_agg(line, chr(10) order by idx)) as body_hash from chain group by doc_id, version_seq"),
    "hash_gate_skipped": (
        hash_gate_skipped,
        f"""with {CHAIN_SQL}, b as (select doc_id, version_seq, sha256(string_agg(line, chr(10) order by idx)) h from chain group by all), g as (select version_seq, h = lag(h) over (partition by doc_id order by version_seq) s from b)
select version_seq, count(*) as versions, count(*) filter (s) as skipped from g group by version_seq""",
    ),
    "data_cards": (
        data_cards,
        """select o_custkey as path, max_by(o_orderpriority, (o_orderdate::date, o_orderpriority)) as title, min(case when o_orderstatus = 'F' then o_orderdate::date end) as first_fetched,
min(o_orderdate::date) as first_version, max(o_orderdate::date) as latest_version, count(*) - 1 as change_count from orders group by o_custkey""",
    ),
    "version_layer_deadline": (
        version_layer_deadline,
        """select o_orderkey, case when s > o_orderdate::date then s - 1 end as action_deadline from orders join (select l_orderkey, min(l_shipdate)::date s from lineitem group by 1) on l_orderkey = o_orderkey""",
    ),
    "unique_titles": (unique_titles, f"with {LINES_SQL} select doc_id, md5(line) as title, min(idx) as idx from lines group by doc_id, line having count(*) = 1"),
    "exact_key_diff": (
        exact_key_diff,
        f"""with {CHAIN_SQL}, c as (select doc_id, version_seq v, sha256(regexp_replace(line, '\\s+', '', 'g')) k, count(*) n from chain group by all), p as (select distinct doc_id, v from c where v > 1),
d as (select coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.v, b.v + 1) v, coalesce(a.n, 0) x, coalesce(b.n, 0) y from c a full join c b on a.doc_id = b.doc_id and a.k = b.k and a.v = b.v + 1)
select doc_id, v as version_seq, sum(least(x, y))::bigint as same, sum(greatest(y - x, 0))::bigint as removed, sum(greatest(x - y, 0))::bigint as added from d semi join p using (doc_id, v) group by doc_id, v""",
    ),
    "clause_pairing": (clause_pairing, None),
    "moved_unit_suppression": (
        moved_unit_suppression,
        f"""{_KEYED}, o as (select * from k where version_seq = 2), n as (select * from k where version_seq = 3),
g as (select o.* from o where not exists (select 1 from n where n.doc_id = o.doc_id and n.idx = o.idx and n.key = o.key)), h as (select n.* from n where not exists (select 1 from o where n.doc_id = o.doc_id and n.idx = o.idx and n.key = o.key))
select doc_id, count(*) as n, 'removed' as kind from g where not exists (select 1 from n where n.doc_id = g.doc_id and n.key = g.key) group by doc_id
union all select doc_id, count(*), 'added' from h where not exists (select 1 from o where o.doc_id = h.doc_id and o.key = h.key) group by doc_id""",
    ),
    "lineage_chains": (
        lineage_chains,
        """select l_orderkey || '@' || l_linenumber as node, l_orderkey || '@' || min(l_linenumber) over (partition by l_orderkey) as lineage from (select distinct l_orderkey, l_linenumber from lineitem)""",
    ),
    "lineage_of_lines": (
        lineage_of_lines,
        f"""{_KEYED}, n as (select *, row_number() over (partition by doc_id, version_seq, key order by idx) nth from k),
g as (select doc_id, count(*) versions, min((version_seq, idx)) f, min_by(idx, (version_seq, idx)) i, min(version_seq) v from n group by doc_id, key, nth) select doc_id, i || '@' || v as lineage, versions from g""",
    ),
    "score_carry_forward": (score_carry_forward, f"{_HISTORY} select id, carried from f"),
    "score_delta_flags": (score_delta_flags, f"{_HISTORY} select id, score_delta, flag from f"),
    "became_unfavorable": (became_unfavorable, f"{_HISTORY} {_FLAGGED.format('became')}"),
    "removed_unfavorable": (removed_unfavorable, f"{_HISTORY} {_FLAGGED.format('removed')}"),
    "history_versions": (history_versions, f"with {FACTS_SQL} select path, version_date, count(*) as changed, count(*) filter (change_type = 'added') as added from facts group by path, version_date"),
    "history_stats": (
        history_stats,
        f"with {FACTS_SQL} select 'changes' as table_name, count(*) as n from facts union all select 'versions', count(*) from (select distinct path, version_date from facts) union all select 'documents', count(distinct path) from facts",
    ),
    "timeline_range": (
        timeline_range,
        f"""with {FACTS_SQL}, i as (select *, version_date between date '1997-01-01' and date '1997-12-31' as inside from facts), s as (select *, bool_or(inside) over (partition by path) as some_in from i)
select path, id, row_number() over (partition by path order by version_date, id) as place, some_in as date_matched from s where inside or not some_in""",
    ),
    "changes_between_topn": (
        changes_between_topn,
        f"with {FACTS_SQL} select id, path, version_date, change_type from facts where version_date between date '1998-01-01' and date '1998-06-30' order by version_date desc, id limit 50",
    ),
    "stored_history": (
        stored_history,
        f"with {FACTS_SQL} select path, count(*) as changes, max_by(id, (version_date, id)) as newest, max(version_date) as version_date from facts where id % 20 = 10 group by path",
    ),
    "month_day_filter": (month_day_filter, f"with {FACTS_SQL} select id, path, version_date from facts where strftime(version_date, '%m-%d') = '07-25'"),
    "latest_by_lineage": (latest_by_lineage, f"with {FACTS_SQL} select path, max_by(id, (version_date, id)) as id, max(version_date) as version_date from facts group by path"),
    "timeline_head_tail": (
        timeline_head_tail,
        f"""with {FACTS_SQL}, r as (select *, row_number() over (partition by path order by version_date, id) up, row_number() over (partition by path order by version_date desc, id desc) down from facts)
select path, id, version_date from r where up <= 2 or down <= 6""",
    ),
    "last_versions": (
        last_versions,
        f"with {FACTS_SQL}, d as (select distinct path, version_date from facts), r as (select *, row_number() over (partition by path order by version_date desc) back from d) select path, version_date, back from r where back <= 30",
    ),
    "word_changes": (word_changes, f"with {LINES_SQL} select doc_id, idx, '(rev)' as inserted, false as deleted from lines where idx % 5 <> 3 and idx % 7 = 2"),
}
