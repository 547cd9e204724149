"""Parts of question answering that are data: evidence, turns, limits, highlights, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import neighbour_pairs

# Fixed values of the decisions.
DIRECT, DIRECT_NAMED, CLARIFY, RELEVANT, SUFFICIENT, NOT_FOUND = 0.5, 0.3, 0.5, 0.5, 0.6, 0.35
HISTORY_TURNS = 3
HIGHLIGHT_LEAST, HIGHLIGHT_MOST = 0.3, 2


def evidence(branches: list[tuple[str, DataFrame]], question: str = "question") -> DataFrame:
    """Typed evidence of several branches (question, key, text, rank) as one table with tags such as C1, C2, T1, numbered for each question."""
    out = None
    for kind, rows in branches:
        nth = F.row_number().over(Window.partitionBy(question).orderBy("rank", "key"))
        tagged = rows.select(question, F.lit(kind).alias("kind"), "key", "text", F.concat(F.lit(kind), nth.cast("string")).alias("tag"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def merge_rows(old: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    """Old rows, then new ones that the old lack."""
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("side", order))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")


def last_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", most: int = HISTORY_TURNS, chars: int = 2000) -> DataFrame:
    """The last ``most`` turns of each conversation that have a text, clipped to ``chars``."""
    spoken = turns.where(F.length(F.trim(text)) > 0)
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return spoken.withColumn("back", back.cast("long")).where(F.col("back") <= most).withColumn(text, F.substring(text, 1, chars))


def route(direct: Column, company_needed: Column, named: Column, every_company: Column) -> Column:
    """direct, clarify or rag by the probabilities of a judge; a null probability goes on to rag."""
    low = F.when(named, DIRECT_NAMED).otherwise(DIRECT)
    return F.when(direct < low, "direct").when(~named & ~every_company & (company_needed >= CLARIFY), "clarify").otherwise("rag")


def abstain_reason(relevant: Column, sufficiency: Column) -> Column:
    return F.when(relevant.isNull(), "unknown").when((relevant == 0) | (sufficiency < NOT_FOUND), "not_found").otherwise("insufficient")


def grade_key(kind: Column, document: Column) -> Column:
    """Key of a judgement: the kind of question and all that the judge is shown of the document (a struct), so that a text cut otherwise is judged anew."""
    return F.sha2(F.concat_ws("\x01", kind, F.to_json(document)), 256)


def judged_once(evidence: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence (key) that a memo (key, grade) already has the grade of, and one row for each key that is still to be judged."""
    return evidence.join(memo, "key"), evidence.join(memo.select("key"), "key", "left_anti").dropDuplicates(["key"])


def fit_batches(sizes: Column, limit: int) -> Column:
    """Batch number of each size in order: a batch is closed before it would exceed ``limit``."""
    start = F.struct(F.lit(0).alias("used"), F.array(F.lit(0)).alias("of"))

    def add(state: Column, size: Column) -> Column:
        last = F.element_at(state["of"], -1)
        opens = (state["used"] > 0) & (state["used"] + size > limit)
        return F.struct(F.when(opens, size).otherwise(state["used"] + size).cast("int").alias("used"), F.concat(state["of"], F.array(F.when(opens, last + 1).otherwise(last))).alias("of"))

    return F.slice(F.aggregate(F.transform(sizes, lambda s: s.cast("int")), start, add)["of"], 2, F.greatest(F.size(sizes), F.lit(1)))


def highlights(answers: DataFrame, evidence_lines: DataFrame, by: str, least: float = HIGHLIGHT_LEAST, most: int = HIGHLIGHT_MOST) -> DataFrame:
    """For each answer sentence (by, a_no, a_grams) up to ``most`` evidence sentences (by, e_no, e_grams) that share character pairs: dice, rank.

    Sentences meet where they share a pair, and the pairs that both hold are counted, so no list is compared with another.
    """
    one = answers.select(by, "a_no", F.size("a_grams").alias("a_size"), F.explode("a_grams").alias("gram"))
    two = evidence_lines.select(by, "e_no", F.size("e_grams").alias("e_size"), F.explode("e_grams").alias("gram"))
    met = one.join(two, [by, "gram"]).groupBy(by, "a_no", "e_no").agg(F.count("*").alias("common"), F.first("a_size").alias("a_size"), F.first("e_size").alias("e_size"))
    near = met.withColumn("dice", 2.0 * F.col("common") / (F.col("a_size") + F.col("e_size"))).where(F.col("dice") >= least)
    rank = F.row_number().over(Window.partitionBy(by, "a_no").orderBy(F.desc("dice"), "e_no")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "a_no", "e_no", "dice", "rank")


def grams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a text in lower case without white space."""
    return F.array_distinct(neighbour_pairs(F.regexp_replace(F.lower(text), r"\s+", "")))
