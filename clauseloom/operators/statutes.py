"""Statutes as Markdown: their articles and headings, look-ups as of a day, and citations of a statute by its name alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import NameFinder
from .linking import ARTICLES_MAX, QUOTES, TITLE_MIN

#: Names that one pass over texts looks for.
NAMES = 200_000
# Lines of a statute's head, headings of articles and parts, how much of an article is shown.
META = r"(?m)^(제목|시행일자|공포일자|상태|출처):\s*(.+?)\s*$"
ARTICLE_LINE = r"^#+\s*제\s*(\d+)\s*조(?:\s*의\s*(\d+))?\s*(?:\(([^)\n]*)\))?"
PART_LINE = r"^#+\s*(제\s*\d+\s*(?:편|장|절|관)\b.*)$"
META_CHARS, ARTICLE_CHARS = 3000, 3000
# Characters around a statute's name that say what is meant, endings of title words, and words that say nothing.
BEFORE, BEHIND = 200, 100
ENDINGS = ("에서의", "에관한", "에대한", "에따른", "등의")
GENERIC = ("목적", "정의", "적용", "범위", "적용범위", "적용제외", "관계", "벌칙", "과태료", "시행", "보칙", "총칙", "효과", "특례", "위임", "권한", "다른", "법률", "등", "절차", "기준", "방법", "사항", "경우")
ARTICLE_BEHIND = r"\s*(시행령|시행규칙)?\s*제\s*\d+\s*조"


def statute_meta(raw: Column) -> Column:
    """Map of a statute's head: title, dates, state and source by their names; of repeated ones the last."""
    head = F.substring(raw, 1, META_CHARS)
    names, values = (F.regexp_extract_all(head, F.lit(META), F.lit(n)) for n in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    keys = F.array_distinct(names)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def statute_articles(statutes: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Articles of Markdown statutes: ``keys``, position (of the heading), article, title, part and text (its heading without marks, then its lines).

    An article reaches to the next heading of any kind. Where an article's number comes again, the last text counts, with the title of each.
    """
    body = F.when(F.col(raw).startswith("---"), F.element_at(F.split(F.col(raw), "\n---", 3), -1)).otherwise(F.col(raw))
    lines = statutes.select(*keys, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("n", "line"))
    upto = Window.partitionBy(*keys).orderBy("n")
    heading = F.col("line").startswith("#")
    number, branch = F.regexp_extract("line", ARTICLE_LINE, 1), F.regexp_extract("line", ARTICLE_LINE, 2)
    article = F.when(number != "", F.concat(F.lit("제"), number, F.lit("조"), F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise("")))
    part = F.trim(F.regexp_extract("line", PART_LINE, 1))
    marked = lines.withColumn("opens", F.when(heading, F.col("n"))).withColumn("article", F.when(heading, article)).withColumn("is_part", heading & F.col("article").isNull() & (part != ""))
    held = marked.withColumn("at", F.last("opens", ignorenulls=True).over(upto)).withColumn("part", F.coalesce(F.last(F.when(F.col("is_part"), part), ignorenulls=True).over(upto), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("n", F.when(heading, F.trim(F.regexp_replace("line", "^#+", ""))).otherwise(F.col("line")).alias("line"))))
    each = held.where("at is not null").groupBy(*keys, "at").agg(
        F.max("article").alias("article"), F.max(F.when(heading, F.trim(F.regexp_extract("line", ARTICLE_LINE, 3)))).alias("title"), F.min_by("part", "n").alias("part"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text")
    )
    found = each.where("article is not null").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    last = F.last("text").over(Window.partitionBy(*keys, "article").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("text", last).withColumnRenamed("at", "position").select(*keys, "position", "article", "title", "part", "text")


def article_text(cited: DataFrame, articles: DataFrame, on: list[str]) -> DataFrame:
    """``cited`` (with article) with part and text of the article, cut to what is shown; articles that do not exist are left out."""
    known = articles.groupBy(*on, "article").agg(F.max_by("part", "position").alias("part"), F.max_by("text", "position").alias("text"))
    return cited.join(known.withColumn("text", F.substring("text", 1, ARTICLE_CHARS)), [*on, "article"])


def title_terms(title: Column) -> Column:
    """Words of an article's title that can tell it from others, without endings and words that all titles have."""

    def bare(word: Column) -> Column:
        for end, least in (*((e, len(e) + 1) for e in ENDINGS), ("의", 4), ("등", 3)):
            word = F.when(F.length(word) >= least, F.regexp_replace(word, end + "$", "")).otherwise(word)
        return word

    words = F.transform(F.split(title, r"[\sㆍ·,]+"), bare)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*GENERIC))


def find_names(texts: DataFrame, key: str, text: str, names: Iterable[str], longest_first: bool = False) -> DataFrame:
    """key, name, start and end of every place of every name; with ``longest_first``, without places that start inside that of a longer name.

    Names are written without spaces, which texts may have anywhere inside them. ``NAMES`` of them are looked up in one pass over the texts, in time that does not
    depend on their number; more take more passes, and cannot be looked up longest first. A null text has no places.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    passes: list[list[str]] = [[]]
    for name in dict.fromkeys(names):
        if len(passes[-1]) == NAMES:
            passes.append([])
        passes[-1].append(name)
    if longest_first and len(passes) > 1:
        raise ValueError(f"longest first, {NAMES} names at most")

    def look(known: list[str]) -> DataFrame:
        def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = NameFinder(known)
            places = finder.longest_first if longest_first else finder.places
            for frame in frames:
                found = [(k, known[n], a, b) for k, t in zip(frame["key"], frame["text"]) for n, a, b in places(t or "")]
                yield pd.DataFrame(found, columns=["key", "name", "start", "end"])

        return rows.mapInPandas(find, f"key {kind}, name string, start long, end long")

    return reduce(DataFrame.unionByName, map(look, passes)).withColumnRenamed("key", key)


def named_statutes(texts: DataFrame, key: str, text: str, names: dict[str, str]) -> DataFrame:
    """Statutes that texts cite by name, without an article: key, nth, law, category, context (what stands around the first such place, without the name).

    ``names`` maps names and short names, without spaces, to statutes; spaces and middle dots may differ in the text. Longer names take their
    characters first. A name with an article behind it is a citation of that article and is left out.
    """
    kind = texts.schema[key].dataType.simpleString()
    drop = str.maketrans({c: " " for c in QUOTES})
    known, laws = list(names), list(names.values())

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = NameFinder(known)
        for frame in frames:
            rows = []
            for k, raw in zip(frame["key"], frame["text"]):
                plain, seen = (raw or "").translate(drop), {}
                for n, start, end in finder.longest_first(plain):
                    behind = plain[end : end + 20]
                    if re.match(ARTICLE_BEHIND, behind):
                        continue
                    rank = re.match(r"\s*(시행령|시행규칙)", behind)
                    seen.setdefault((laws[n], rank[1] if rank else "법률"), plain[max(0, start - BEFORE) : start] + " " + plain[end : end + BEHIND])
                rows += [(k, n, law, category, context) for n, ((law, category), context) in enumerate(seen.items())]
            yield pd.DataFrame(rows, columns=["key", "nth", "law", "category", "context"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(find, f"key {kind}, nth int, law string, category string, context string").withColumnRenamed("key", key)


def resolve_names(named: DataFrame, key: str, articles: DataFrame, hint: Column | None = None, least: int = TITLE_MIN, most: int = ARTICLES_MAX) -> DataFrame:
    """Articles of statutes cited by name whose titles' words stand in the context: key, law, category, article, score, rank.

    By the matched words' length, then the share of the title that is matched, then position. ``hint`` goes before the context.
    """
    whole = F.concat_ws(" ", hint, "context") if hint is not None else F.col("context")
    asked = named.withColumn("__ctx", F.regexp_replace(whole, r"\s+", ""))
    headings = articles.select("law", "category", "article", "position", title_terms(F.col("title")).alias("terms")).where(F.size("terms") > 0)
    met = asked.join(headings, ["law", "category"]).withColumn("hit", F.filter("terms", lambda t: F.contains(F.col("__ctx"), t)))
    scored = met.withColumn("score", F.aggregate("hit", F.lit(0), lambda n, t: n + F.length(t)).cast("long")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy(key, "law", "category").orderBy(F.desc("score"), F.desc(F.size("hit") / F.size("terms")), "position")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "law", "category", "article", "score", "rank")


def in_force(asked: DataFrame, versions: DataFrame, on: list[str], day: str) -> DataFrame:
    """``asked`` with version: the latest promulgated by ``day`` whose effective date (where unknown, that of its promulgation) has come; without one a row is left out.

    ``versions``: ``on``, version, promulgated and effective.
    """
    since = F.greatest("promulgated", F.coalesce("effective", "promulgated"))
    known = versions.select(*on, F.struct("promulgated", "version").alias("__v"), since.alias("__since"))
    rows = asked.withColumn("__row", F.monotonically_increasing_id())
    left = rows.select(*on, F.col(day).alias("__at"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__own"), F.lit(None).cast(known.schema["__v"].dataType).alias("__v"))
    right = known.select(*on, F.col("__since").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__own"].dataType).alias("__own"), "__v")
    upto = Window.partitionBy(*on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = left.unionByName(right).withColumn("__v", F.max("__v").over(upto)).where("__side = 1 and __v is not null")
    return held.select("__own.*", F.col("__v.version").alias("version")).drop("__row")


def laws_of_evidence(evidence: DataFrame, cited: DataFrame, named: DataFrame, grades: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """What statutes evidence cites, once each: law, category, article (null: by name alone), as_of, cited_by (ids in order), by number first.

    ``evidence``: id, as_of and rank; ``cited``: id, nth, law, category, article; ``named``: id, law, category. A name counts only where
    its evidence does not cite an article of that statute, and only from a grade (id, grade) of ``least`` on.
    """
    at = evidence.select("id", "as_of", "rank")
    numbered = cited.join(at, "id").select("law", "category", "article", "as_of", "id", "rank", "nth")
    free = named.join(cited.select("id", "law").distinct(), ["id", "law"], "left_anti")
    free = free if grades is None else free.join(grades.where(F.col("grade") >= least).select("id"), "id", "left_semi")
    bare = free.join(at, "id").select("law", "category", F.lit(None).cast("string").alias("article"), "as_of", "id", "rank", F.lit(0).alias("nth"))
    every = numbered.unionByName(bare)
    own = F.when(F.col("article").isNull(), F.col("id").cast("string"))  # a name stands for its evidence alone
    found = every.groupBy("law", "category", "article", "as_of", own.alias("__own")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "id"))), lambda s: s["id"]).alias("cited_by"), F.min(F.struct("rank", "nth")).alias("__first")
    )
    order = Window.partitionBy("as_of").orderBy(F.col("article").isNull(), "__first", "law", "category")
    return found.withColumn("place", F.row_number().over(order).cast("long")).drop("__own", "__first")
