"""Queries over clause scores, their evaluation and question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as E
from ..operators import questions as Q
from ..operators import scoring as S
from ..tables import LINES_SQL, document_lines, table
from .text_queries import normalize_sql, quote

#: A small cue table over texts of the Latin alphabet: weight and expression.
CUES = [(-2, "(?i)token|secret|password"), (-1, "!!"), (-1, r"\d{3}"), (1, " and | und "), (2, "(?i)license")]
THRESHOLDS = [n / 10 for n in range(-20, 1)]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_units(document_lines(table(spark, sf_dir, "documents")), "line", CUES).select("doc_id", F.col("idx").cast("long").alias("idx"), "lang", "source", "score.*")


def _human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their worst line: quality 0 stands for level -1, 1 for 1."""
    low = S.worst(_lines(spark, sf_dir), ["doc_id"], "favor_score", "idx")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (2 * F.col("quality") - 1).alias("human"))
    return labels.join(low, "doc_id").withColumn("level", F.greatest(F.lit(-2), F.least(F.lit(2), F.round("favor_score", 0).cast("int"))))


def cue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "idx", "favor_score", "favor_confidence")


def probs_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    weights = F.array(*(F.pmod(F.col("p_size") * k + F.col("p_partkey"), F.lit(m)).cast("double") for k, m in ((1, 7), (2, 5), (3, 11), (5, 3), (7, 2))))
    return parts.select("p_partkey", text.probabilities_to_score(weights).alias("s")).select("p_partkey", "s.favor_score", "s.favor_confidence")


def worst_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.worst(_lines(spark, sf_dir), ["doc_id"], "favor_score", "idx").select("doc_id", "favor_score", "idx", F.col("of").alias("units"))


def unfavorable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).where((F.col("favor_score") <= -0.7) & F.col("source").startswith("src1"))
    return found.groupBy("source", "favor_score").agg(F.count("*").alias("clauses"), F.min("doc_id").alias("first_doc"))


def score_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score keys of English and German lines that lines of other languages have not had scored."""
    keyed = document_lines(table(spark, sf_dir, "documents")).select("lang", S.cache_key("rules", F.lit("doc"), F.lit(""), F.col("line")).alias("key"))
    wanted, cache = keyed.where(F.col("lang").isin("en", "de")), keyed.where(~F.col("lang").isin("en", "de")).select("key").distinct()
    return S.cache_misses(wanted, cache)


def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 800 characters of all longer documents: they cover the text without gaps."""
    docs = table(spark, sf_dir, "documents")
    windows = S.score_windows(docs, "doc_id", "text", 800)
    return windows.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.max(F.col("end") - F.col("start")).alias("longest"))


def window_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in spans of 480 characters: the worst span's score and how many there are."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(480)))
    spans = docs.select("doc_id", "text", starts.alias("start")).select("doc_id", "start", F.col("text").substr(F.col("start") + 1, F.lit(480)).alias("span"))
    scored = spans.select("doc_id", F.col("start").cast("long").alias("start"), S.cue_score(F.col("span"), CUES).alias("s")).select("doc_id", "start", F.col("s.favor_score").alias("favor_score"))
    return S.worst(scored, ["doc_id"], "favor_score", "start").withColumnRenamed("of", "windows")


def threshold_f1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _human(spark, sf_dir).withColumn("truth", F.col("human") <= -0.7)
    thresholds = spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    found = E.threshold_sweep(labelled, "truth", "favor_score", thresholds)
    return found.select("threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "place")


def label_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.agreement(_human(spark, sf_dir), "human", "level", ["human"])
    return found.select(F.col("human").cast("long").alias("human"), "labels", *(F.round(c, 6).alias(c) for c in ("mae", "exact", "within_one")))


def history_turns_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "back", "text")


def conversation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five conversations with the most turns of each first role."""
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.min_by("role", "turn").alias("role"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("turns"), "conv_id")).cast("long")
    return each.withColumn("place", place).where("place <= 5")


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts and nations as two kinds of evidence for five questions."""
    docs = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).cast("long").alias("question"), F.col("item_id").alias("key"), "text", F.col("item_id").alias("rank"))
    parts = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("question"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("text"), (-F.col("n_nationkey")).cast("long").alias("rank"))
    return Q.evidence([("C", docs), ("H", parts)])


def keep_only_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(kept, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("kept"))


def merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part and supplier of orders, graded lines of earlier ship dates before later ones."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey"), "l_orderkey", "l_linenumber")
    old, new = items.where("l_linenumber = 1"), items.where("l_linenumber > 1")
    order = F.struct("l_orderkey", "l_linenumber")
    merged = Q.merge_rows(old.withColumn("o", order), new.withColumn("o", order), ["l_partkey", "l_suppkey"], "o")
    return merged.select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def batch_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document dealt into batches of 2,000 characters in order."""
    sizes = F.transform(F.split("text", "\n"), lambda s: F.length(s))
    docs = table(spark, sf_dir, "documents").select("doc_id", Q.fit_batches(sizes, 2000).alias("of"), sizes.alias("sizes"))
    each = docs.select("doc_id", F.explode(F.arrays_zip("of", "sizes")).alias("z"))
    return each.groupBy("doc_id", F.col("z.of").cast("long").alias("batch")).agg(F.sum("z.sizes").alias("chars"), F.count("*").alias("lines"))


def highlight_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation against the questions of the same one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.grams(F.col("text")).alias("g"))
    answers = turns.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("a_no"), F.col("g").alias("a_grams"))
    asked = turns.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("e_no"), F.col("g").alias("e_grams"))
    return Q.highlights(answers, asked, "conv_id").select("conv_id", "a_no", "e_no", F.round("dice", 6).alias("dice"), "rank")


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    p = lambda m: F.pmod(F.col("p_partkey") * m, F.lit(101)) / 100
    route = Q.route(p(7), p(13), F.pmod("p_size", F.lit(2)) == 0, F.pmod("p_size", F.lit(5)) == 0)
    why = Q.abstain_reason(F.when(F.col("p_size") > 3, F.pmod("p_size", F.lit(4))), p(3))
    return parts.groupBy(route.alias("route"), why.alias("reason")).agg(F.count("*").alias("questions"))


def _score_sql(x: str) -> str:
    hit = [f"regexp_matches({x}, {quote(p)})" for _, p in CUES]
    total = " + ".join(f"case when {h} then {w} else 0 end" for h, (w, _) in zip(hit, CUES))
    return f"greatest(-2.0, least(2.0, ({total})::double))", f"case when {' or '.join(hit)} then 0.7::double else 1.0::double end"


def _from_bell(rest: str) -> str:
    """favor_score and favor_confidence from columns t and s of a bell."""
    bell = [f"exp(-(({v}::double - t) * ({v}::double - t)) / (2 * s * s))" for v in (-2, -1, 0, 1, 2)]
    total = "(" + " + ".join(bell) + ")"
    expected = " + ".join(f"{v} * {b} / {total}" for v, b in zip((-2, -1, 0, 1, 2), bell))
    return f"select {rest}, round({expected}, 3) as favor_score, round(greatest({', '.join(bell)}) / {total}, 3) as favor_confidence"


_T, _S = _score_sql("n")
_LINE_SCORES = f"""with {LINES_SQL}, n as (select doc_id, idx, lang, source, {normalize_sql('line')} n from lines), b as (select doc_id, idx, lang, source, {_T} t, {_S} s from n), scored as ({_from_bell('doc_id, idx, lang, source')} from b)"""
_HUMAN = f"""{_LINE_SCORES}, low as (select doc_id, min(favor_score) favor_score from scored group by doc_id), human as (select doc_id, 2 * quality - 1 human, favor_score, greatest(-2, least(2, round(favor_score)::int)) as level from labels join low using (doc_id) where quality is not null)"""
_T2, _S2 = _score_sql("n")
_W = [f"((p_size * {k} + p_partkey) % {m})::double" for k, m in ((1, 7), (2, 5), (3, 11), (5, 3), (7, 2))]
_WT = "(" + " + ".join(_W) + ")"

QUERIES = {
    "cue_scores": (cue_scores, f"{_LINE_SCORES} select doc_id, idx, favor_score, favor_confidence from scored"),
    "probs_to_score": (
        probs_to_score,
        f"select p_partkey, case when {_WT} > 0 then round((-2 * {_W[0]} / {_WT}) + (-1 * {_W[1]} / {_WT}) + ({_W[3]} / {_WT}) + (2 * {_W[4]} / {_WT}), 3) else 0.0 end as favor_score, case when {_WT} > 0 then round(greatest({', '.join(_W)}) / {_WT}, 3) else 1.0 end as favor_confidence from part",
    ),
    "worst_unit": (worst_unit, f"{_LINE_SCORES} select doc_id, min(favor_score) as favor_score, min_by(idx, (favor_score, idx)) as idx, count(*) as units from scored group by doc_id"),
    "unfavorable_search": (
        unfavorable_search,
        f"{_LINE_SCORES} select source, favor_score, count(*) as clauses, min(doc_id) as first_doc from scored where favor_score <= -0.7 and source like 'src1%' group by source, favor_score",
    ),
    "score_cache_misses": (
        score_cache_misses,
        f"""with {LINES_SQL}, k as (select lang, sha256({normalize_sql("concat_ws(chr(10), 'rules', 'doc', '', line)")}) as key from lines)
select key, count(*) as uses from k where lang in ('en', 'de') and key not in (select key from k where lang not in ('en', 'de')) group by key""",
    ),
    "window_spans": (window_spans, None),
    "window_combine": (
        window_combine,
        f"""with s as (select doc_id, text, unnest(generate_series(0, length(text) - 1, 480)) as start from documents where length(text) > 0), n as (select doc_id, start, substring(text, start + 1, 480) n from s),
b as (select doc_id, start, {_T2} t, {_S2} s from n), c as ({_from_bell('doc_id, start')} from b) select doc_id, min(favor_score) as favor_score, min_by(start, (favor_score, start)) as start, count(*) as windows from c group by doc_id""",
    ),
    "threshold_f1_sweep": (
        threshold_f1_sweep,
        f"""{_HUMAN}, t as (select unnest([{', '.join(map(str, THRESHOLDS))}])::double as threshold), c as (select threshold, count(*) filter (favor_score <= threshold and human <= -0.7) tp, count(*) filter (favor_score <= threshold and human > -0.7) fp,
count(*) filter (favor_score > threshold and human <= -0.7) fn from human, t group by threshold), f as (select *, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end f from c)
select threshold, tp, fp, fn, round(f, 6) as f1, row_number() over (order by f desc, threshold) as place from f""",
    ),
    "label_mae": (
        label_mae,
        f"""{_HUMAN} select human::bigint as human, count(*) as labels, round(avg(abs(human - level)), 6) as mae, round(avg((human = level)::int), 6) as exact, round(avg((abs(human - level) <= 1)::int), 6) as within_one from human group by human""",
    ),
    "history_turns_clip": (
        history_turns_clip,
        "with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) back from conversations where length(trim(text)) > 0) select conv_id, turn, back, substring(text, 1, 2000) as text from r where back <= 3",
    ),
    "conversation_retention": (
        conversation_retention,
        """with e as (select conv_id, max(turn) turns, min_by(role, turn) role from conversations group by conv_id), r as (select *, row_number() over (partition by role order by turns desc, conv_id) place from e) select conv_id, turns, role, place from r where place <= 5""",
    ),
    "evidence_union": (
        evidence_union,
        """select (item_id % 5)::bigint as question, 'C' as kind, item_id as key, text, 'C' || row_number() over (partition by item_id % 5 order by item_id) as tag from benchmark
union all select n_regionkey, 'H', n_nationkey, n_name, 'H' || row_number() over (partition by n_regionkey order by -n_nationkey) from nation""",
    ),
    "keep_only_semi": (keep_only_semi, "select source, count(*) as kept from documents where doc_id in (select doc_id from labels where quality = 1) group by source"),
    "merge_priority": (
        merge_priority,
        """with r as (select l_partkey, l_suppkey, l_orderkey, l_linenumber::bigint as l_linenumber, row_number() over (partition by l_partkey, l_suppkey order by l_linenumber > 1, l_orderkey, l_linenumber) n from lineitem) select l_partkey, l_suppkey, l_orderkey, l_linenumber from r where n = 1""",
    ),
    "batch_prefix": (
        batch_prefix,
        f"""with recursive {LINES_SQL}, r as (select doc_id, idx, length(line) used, length(line) size, 0 as batch from lines where idx = 0
union all select l.doc_id, l.idx, case when r.used > 0 and r.used + length(l.line) > 2000 then length(l.line) else r.used + length(l.line) end, length(l.line), case when r.used > 0 and r.used + length(l.line) > 2000 then r.batch + 1 else r.batch end
from r join lines l on l.doc_id = r.doc_id and l.idx = r.idx + 1) select doc_id, batch::bigint as batch, sum(size)::bigint as chars, count(*) as lines from r group by doc_id, batch""",
    ),
    "highlight_dice": (
        highlight_dice,
        """with p as (select conv_id, turn, regexp_replace(lower(text), '\\s+', '', 'g') t from conversations), g as (select conv_id, turn, list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substring(t, i, 2))) g from p),
m as (select a.conv_id, a.turn a_no, e.turn e_no, 2.0::double * len(list_intersect(a.g, e.g)) / (len(a.g) + len(e.g)) d from g a join g e on a.conv_id = e.conv_id and a.turn % 2 = 1 and e.turn % 2 = 0),
r as (select *, row_number() over (partition by conv_id, a_no order by d desc, e_no) rank from m where d >= 0.3) select conv_id, a_no, e_no, round(d, 6) as dice, rank from r where rank <= 2""",
    ),
    "question_routes": (
        question_routes,
        """with q as (select p_size, (p_partkey * 7) % 101 / 100 d, (p_partkey * 13) % 101 / 100 c, (p_partkey * 3) % 101 / 100 f, p_size % 2 = 0 named, p_size % 5 = 0 every_one from part)
select case when d < (case when named then 0.3 else 0.5 end) then 'direct' when not named and not every_one and c >= 0.5 then 'clarify' else 'rag' end as route,
case when p_size <= 3 then 'unknown' when p_size % 4 = 0 or f < 0.35 then 'not_found' else 'insufficient' end as reason, count(*) as questions from q group by all""",
    ),
}
