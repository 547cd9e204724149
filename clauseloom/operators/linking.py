"""Links from clauses to cases and statutes, look-ups as of a date, and spans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .views import correction, lossless_diff, one_side

LINK_MIN, LINK_TOP = 0.63, 3
# How a statute's article is cited, and names that stand for the one named before.
CITATION = r"(법률|법)\s*(시행령|시행규칙)?\s*제\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
SAME_LAW = ("동법", "같은법", "동 법", "같은 법")
QUOTES = "「」『』‘’“”\"'<>《》〈〉()（）[]"
TITLE_MIN, ARTICLES_MAX = 3, 2


def best_links(pairs: DataFrame, group: str, case: str, release: str, score: str, least: float = LINK_MIN, most: int = LINK_TOP) -> DataFrame:
    """Up to ``most`` cases of each group, the best of each release: group, case, score, rank."""
    kept = pairs.where(F.col(score) >= least).groupBy(group, case, release).agg(F.max(score).alias(score))
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy(group, release).orderBy(F.desc(score), case))).where("nth = 1")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), case)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(group, case, score, "rank")


def similar_cases(links: DataFrame, cases: DataFrame, group: str, case: str) -> DataFrame:
    """Cases that clauses are linked to (:func:`best_links`) with before and after as they are compared: diff by words, and what each side shows of the difference. Links to cases that are gone are left out."""
    met = links.join(cases, case).withColumn("ops", lossless_diff(F.col("before"), F.col("after")))
    return met.withColumn("diff", correction(F.col("before"), F.col("after"))).withColumn("before_ops", one_side(F.col("ops"), "del")).withColumn("after_ops", one_side(F.col("ops"), "ins")).drop("ops")


def as_of(questions: DataFrame, versions: DataFrame, on: list[str], day: str, question: str, promulgated: str, effective: str, version: str) -> DataFrame:
    """``questions`` with the version in force on the day: the latest promulgated by then whose effective date has come; null where none has.

    Questions and versions go into one order by key, promulgation and day; the last version in force is
    carried forward, so a key with many of both is not multiplied. A version counts from the later
    of its two dates.
    """
    since = F.greatest(F.col(promulgated), F.coalesce(F.col(effective), F.col(promulgated)))
    left = questions.select(*on, F.col(day).alias("at"), F.col(question).alias("q"), F.lit(None).cast("struct<p:timestamp,v:bigint>").alias("version"), F.lit(1).alias("side"))
    right = versions.select(*on, since.alias("at"), F.lit(None).cast("bigint").alias("q"), F.struct(F.col(promulgated).cast("timestamp").alias("p"), F.col(version).cast("bigint").alias("v")).alias("version"), F.lit(0).alias("side"))
    upto = Window.partitionBy(*on).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("known", F.max("version").over(upto))
    return both.where("side = 1").select(*on, F.col("q").alias(question), F.col("at").alias(day), F.col("known.v").alias(version))


def law_name(words: list[str], names: frozenset[str] = frozenset()) -> str:
    """The statute that words end with: the longest known name of up to twelve words, else the last word, or two where the last is only "law"."""
    for n in range(max(0, len(words) - 12), len(words)):
        if "".join(words[n:]) in names:
            return "".join(words[n:])
    return "".join(words[-2:]) if words and words[-1] in ("법", "법률") else "".join(words[-1:])


def citations(texts: DataFrame, key: str, text: str, names: frozenset[str] = frozenset()) -> DataFrame:
    """Statute articles that texts cite, in order and once each: key, nth, law, category, article. "The same law" is the one named before."""
    kind = texts.schema[key].dataType.simpleString()
    drop = str.maketrans({c: " " for c in QUOTES})

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, raw in zip(frame["key"], frame["text"]):
                plain, named, seen = (raw or "").translate(drop), None, {}
                for m in re.finditer(CITATION, plain):
                    words = (plain[max(0, m.start() - 80) : m.start()] + m[1]).split()
                    law = named if {"".join(words[-1:]), " ".join(words[-2:])} & set(SAME_LAW) else law_name(words, names)
                    if law:
                        named = law
                        seen.setdefault((law, m[2] or "법률", f"제{m[3]}조" + (f"의{m[4]}" if m[4] else "")))
                rows += [(k, n, *ref) for n, ref in enumerate(seen)]
            yield pd.DataFrame(rows, columns=["key", "nth", "law", "category", "article"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(find, f"key {kind}, nth int, law string, category string, article string").withColumnRenamed("key", key)


def pick_articles(contexts: DataFrame, key: str, context: str, headings: DataFrame, on: list[str], least: int = TITLE_MIN, most: int = ARTICLES_MAX) -> DataFrame:
    """Articles whose title terms stand in the context: key, article, score, rank; by matched length, then matched share, then position."""
    squeezed = contexts.select(key, *on, F.regexp_replace(context, r"\s+", "").alias("ctx"))
    hit = F.filter("terms", lambda t: F.contains(F.col("ctx"), t))
    scored = squeezed.join(headings, on).withColumn("hit", hit).withColumn("score", F.aggregate("hit", F.lit(0), lambda n, t: n + F.length(t)).cast("long"))
    share = F.size("hit") / F.size("terms")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc(share), "position")).cast("long")
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most).select(key, "article", "score", "rank")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs of spans (a_start, a_end) and (b_start, b_end) of one document that share characters, met on a grid of ``width``."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    met = a.withColumn("cell", cells("a_start", "a_end")).join(b.withColumn("cell", cells("b_start", "b_end")), [*on, "cell"])
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return met.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("cell") == first)).drop("cell")


def covered(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """How many characters the union of each group's spans has."""
    before = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return spans.withColumn("fresh", fresh).groupBy(*by).agg(F.sum("fresh").alias("covered"))


def reference_key(law: Column, category: Column, article: Column) -> Column:
    return F.concat_ws("/", law, category, article)
