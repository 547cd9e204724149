"""A stored keyword index: postings in blocks by term and impact, and searches that leave blocks out.

Texts are tokenised once, when the index is written. The postings of a term are cut into blocks of like impact, so
that a block's largest impact says much about all of it. A search first scores what the best blocks
hold; the score of its last result is then a threshold that most blocks cannot reach any more. Ranks and scores
are those of scoring every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..tables import stored

# Fixed values of the ranking.
K1, B = 1.2, 0.75
#: Postings of a block, about, and levels of impact that a term's blocks have.
BLOCK, LEVELS = 128, 16
#: Blocks of each query that are scored for a first threshold.
SEEDS = 8
#: What sums of doubles in different orders may differ by.
SLACK = 1e-9


@dataclass(frozen=True)
class Postings:
    """``blocks``: block (a number), term, top (largest impact) and rows (key, impact and ``extra`` columns); ``terms``: term, df, idf, top; ``documents``: how many there are."""

    blocks: DataFrame
    terms: DataFrame
    documents: int
    key: str
    extra: tuple[str, ...] = ()


def term_counts(docs: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """term, key, ``extra``, len (terms of the document) and tf of every term of every document."""
    cut = docs.select(F.col(key), *extra, tokens(F.col(text)).alias("__terms")).withColumn("len", F.size("__terms").cast("long"))
    return cut.select(key, *extra, "len", F.explode("__terms").alias("term")).groupBy("term", key, *extra, "len").agg(F.count("*").alias("tf"))


def build_postings(docs: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> Postings:
    """Index of all documents, those without any term included in its statistics. ``extra`` columns are stored with each posting for filters.

    A term that a third of all documents hold is many blocks, dealt by impact and key, never one group.
    Two numbers reach the driver.
    """
    held = stored(term_counts(docs, key, text, extra))
    total = held.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    count = docs.count()
    average = total / count if total else 1.0
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(average))))
    weighed = held.select("term", key, *extra, impact.alias("impact"))
    spread = weighed.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"), F.min("impact").alias("low"))
    idf = F.ln(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = stored(spread.withColumn("idf", idf))
    level = F.when(F.col("top") > F.col("low"), F.floor((F.col("impact") - F.col("low")) / (F.col("top") - F.col("low")) * (LEVELS - 1))).otherwise(0)
    placed = weighed.join(terms.select("term", "df", "low", "top"), "term").withColumn("level", level)
    placed = placed.withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("df") / BLOCK)))
    rows = F.collect_list(F.struct(key, "impact", *extra)).alias("rows")
    blocks = placed.groupBy("term", "level", F.when(F.col("df") > BLOCK, F.col("part")).otherwise(0).alias("part")).agg(F.max("impact").alias("top"), rows)
    return Postings(stored(blocks.select("term", "top", "rows").sortWithinPartitions("term").withColumn("block", F.monotonically_increasing_id())), terms.select("term", "df", "idf", "top"), count, key, extra)


def asked_terms(index: Postings, queries: DataFrame, query: str, text: str) -> DataFrame:
    """``query``, term, idf and most: each query's distinct terms that some document holds, and the most that one can give."""
    terms = queries.select(query, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.join(index.terms, "term").select(query, "term", "idf", (F.col("idf") * F.col("top")).alias("most"))


def _rows(blocks: DataFrame, index: Postings, allowed) -> DataFrame:
    rows = blocks.withColumn("r", F.explode("rows")).drop("rows").select("*", "r.*").drop("r")
    return rows if allowed is None else rows.where(allowed)


def score_all(index: Postings, asked: DataFrame, query: str, allowed=None) -> DataFrame:
    """``query``, key and score of every document that shares a term with a query."""
    rows = _rows(index.blocks.join(asked.select("term").distinct(), "term", "left_semi").select("term", "rows"), index, allowed)
    return rows.join(asked, "term").groupBy(query, index.key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score")).where("score > 0")


def _score(index: Postings, asked: DataFrame, pairs: DataFrame, query: str) -> DataFrame:
    """Scores of given pairs of query and key."""
    wanted = pairs.join(asked, query).select(query, index.key, "term", "idf")
    rows = _rows(index.blocks.join(asked.select("term").distinct(), "term", "left_semi").select("term", "rows"), index, None)
    return wanted.join(rows.select("term", index.key, "impact"), ["term", index.key]).groupBy(query, index.key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score"))


def top_postings(index: Postings, queries: DataFrame, query: str, text: str, k: int, allowed=None, digits: int = 6, seeds: int = SEEDS, report: list | None = None) -> DataFrame:
    """``query``, key, score (to ``digits`` places) and rank of the ``k`` best documents of each query; equal scores by key.

    ``allowed``, a condition over key and ``extra`` columns, restricts results, not statistics. A query's terms count once; a query without any
    known term has no results. Terms are taken in falling order of what they can give. As soon as all terms from one on together cannot
    reach the threshold, no document is looked for in their blocks; nor in a block that cannot with all
    other terms. What is found there counts in full. ``report`` gets the blocks that queries have and those that were gone through.
    """
    key = index.key
    asked = stored(asked_terms(index, queries, query, text))
    falling = Window.partitionBy(query).orderBy(F.desc("most"), "term")
    ranked = asked.withColumn("behind", F.sum("most").over(falling.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("most").over(Window.partitionBy(query)))
    met = index.blocks.select("term", "block", F.col("top").alias("block_top")).join(ranked, "term").withColumn("bound", F.col("idf") * F.col("block_top"))
    held = stored(met.select(query, "block", "bound", "behind", (F.col("all") - F.col("most") + F.col("bound")).alias("reach")))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "block"))).where(F.col("n") <= seeds)
    inside = lambda some: _rows(some.select(query, "block").join(index.blocks.select("block", "rows"), "block"), index, allowed).select(query, key).distinct()
    best = lambda scores: scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))).cast("long")).where(F.col("rank") <= k)
    sown = best(_score(index, asked, inside(first), query))
    least = stored(sown.where(F.col("rank") == k).select(query, (F.col("score") * (1 - SLACK) - 10.0**-digits).alias("least")))
    reaching = held.join(least, query, "left").where(F.col("least").isNull() | ((F.col("behind") >= F.col("least")) & (F.col("reach") >= F.col("least"))))
    if report is not None:
        report.append((held.count(), reaching.count()))
    return best(_score(index, asked, inside(reaching), query))
