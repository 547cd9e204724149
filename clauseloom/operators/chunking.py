"""Two ways to cut texts into spans that search can find, and their comparison on the same questions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, stored
from .frames import slices
from .linking import covered, overlaps
from .term_blocks import build_blocks, top_blocks

# Both ways, line starts that open a section, where paragraphs end, and what counts as found.
WAYS = {"A": (1500, 0), "B": (750, 100)}
SECTION = r"(?m)^(?:#{1,6}\s+[^\n]+|제\s*\d+\s*조(?:\s*의\s*\d+)?\s*[.(（][^\n]*|\d+\.\s*\n\s*\n[^\n]+)"
PARAGRAPH_END = r"\n\s*\n|(?=[①-⑳])|(?m:^\s*\[\d+\])"
TITLE_CHARS, HIT_CHARS, TOP, BUDGET, LEAST_GOLD = 160, 50, 5, 3000, 15
GRID = 4096


def spans_of(body: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, title) of spans of at most ``limit`` characters within sections; together they hold every character but white space.

    A span ends behind the last paragraph in its latter two thirds, else behind a sentence or line in its latter half,
    else anywhere; the next one starts ``overlap`` characters before that.
    """
    edges = sorted({0, len(body), *(m.start() for m in re.finditer(SECTION, body))})
    found = []
    for left, right in zip(edges, edges[1:]):
        title = body[left:right].split("\n", 1)[0][:TITLE_CHARS]
        ends = [left + m.end() for m in re.finditer(PARAGRAPH_END, body[left:right])]
        at = left
        while at < right:
            end = min(at + limit, right)
            if end < right:
                last = bisect_right(ends, end) - 1
                if last >= bisect_left(ends, at + limit // 3):
                    end = ends[last]
                else:
                    cut = max(body.rfind(mark, at + limit // 2, end) for mark in (". ", "\n"))
                    end = cut + 1 if cut >= 0 else end
            if body[at:end].strip():
                found.append((at, end, title))
            at = max(at + 1, end - overlap) if end < right else right
    return found


def chunk(docs: DataFrame, key: str, body: str, ways: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """key, way, nth, start, end, heading and text of every span of every way."""
    ways = ways or WAYS
    kind = docs.schema[key].dataType.simpleString()

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "body"):
            rows = [(k, way, n, a, b, title, t[a:b]) for k, t in zip(frame["key"], frame["body"]) for way, (limit, overlap) in ways.items() for n, (a, b, title) in enumerate(spans_of(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["key", "way", "nth", "start", "end", "heading", "text"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    return rows.mapInPandas(cut, f"key {kind}, way string, nth int, start int, end int, heading string, text string").withColumnRenamed("key", key)


def structure(docs: DataFrame, chunks: DataFrame, key: str, body: str) -> DataFrame:
    """For each text and way: chunks, max_chars, embedded_chars, missing_chars (that no span holds, white space not counted) and mismatched spans."""
    texts = docs.select(key, F.col(body).alias("__body"))
    before = F.coalesce(F.max("end").over(Window.partitionBy(key, "way").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.length("__body")
    marked = chunks.withColumn("before", before).withColumn("last", F.lead("start").over(Window.partitionBy(key, "way").orderBy("start", "end")).isNull()).join(texts, key)
    solid = lambda a, b: F.length(F.regexp_replace(F.substring("__body", a + 1, F.greatest(b - a, F.lit(0))), r"(?U)\s+", ""))
    gap = solid(F.col("before"), F.col("start")) + F.when(F.col("last"), solid(F.greatest("end", "before"), whole)).otherwise(0)
    wrong = (F.col("text") != F.substring("__body", F.col("start") + 1, F.col("end") - F.col("start"))).cast("int")
    return marked.groupBy(key, "way").agg(
        F.count("*").alias("chunks"), F.max(F.length("text")).cast("long").alias("max_chars"), F.sum(F.length("text")).cast("long").alias("embedded_chars"),
        F.sum(gap).cast("long").alias("missing_chars"), F.sum(wrong).cast("long").alias("mismatched"),
    )


def locate_gold(questions: DataFrame, docs: DataFrame, question: str, key: str, gold: str, body: str, least: int = LEAST_GOLD) -> DataFrame:
    """Where the paragraphs of each question's gold text stand in its document: question, key, spans (array of start, end), expected. Questions whose paragraphs are not all found have null spans."""
    parts = F.transform(F.split(F.regexp_replace(F.col(gold), "\r\n", "\n"), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    parts = F.filter(parts, lambda p: F.length(p) >= least)
    met = questions.withColumn("__parts", parts).join(docs.select(key, F.col(body).alias("__body")), key, "left")
    places = F.transform("__parts", lambda p: F.struct((F.instr(F.col("__body"), p) - 1).alias("start"), (F.instr(F.col("__body"), p) - 1 + F.length(p)).alias("end")))
    whole = (F.size("__parts") > 0) & F.forall("__parts", lambda p: F.contains(F.col("__body"), p))
    return met.select(question, key, F.when(whole, places).alias("spans"), F.size("__parts").cast("long").alias("expected"))


def probes(docs: DataFrame, key: str, body: str) -> DataFrame:
    """A question of each document that has one: its middle line of 40 to 180 characters that is no heading or table row: key, question, start, end."""
    lines = docs.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("n", "line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("start", start).where(F.length("line").between(40, 180) & ~F.col("line").startswith("#") & ~F.col("line").startswith("|"))
    nth, of = F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1, F.count("*").over(Window.partitionBy(key))
    middle = placed.withColumn("nth", nth).withColumn("of", of).where(F.col("nth") == F.floor(F.col("of") / 2))
    return middle.select(key, F.col("line").alias("question"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("line")).cast("int").alias("end"))


def search_ways(chunks: DataFrame, questions: DataFrame, key: str, question: str, text: str, top: int = TOP) -> DataFrame:
    """``question``, way, rank, ``key``, start, end: for each way the spans of all texts that keywords rank highest, by an index of that way's spans. ``chunks`` are those of :func:`chunk`."""
    kept = stored(chunks.select("way", F.struct(key, "start", "end").alias("span"), "text"))
    found = []
    for way in sorted(r[0] for r in kept.select("way").distinct().collect()):
        index = build_blocks(kept.where(F.col("way") == way), "span", "text")
        best = top_blocks(index, questions, question, text, top)
        found.append(best.select(question, F.lit(way).alias("way"), "rank", "span.*"))
        discard(index.blocks)  # results are written
    discard(kept)
    return reduce(DataFrame.unionByName, found)


def evaluate(ranked: DataFrame, gold: DataFrame, question: str, key: str, by: list[str], top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """For each question and ``by`` (ways, scopes): hit1, hit5, mrr5 and coverage of the gold spans by the first ``budget`` characters of results.

    ``ranked``: question, ``by``, rank, key, start, end; ``gold``: question, key, spans. A result hits with 50 characters of a gold span, or all of a shorter
    one. Overlapping results cover a character once, but cost their characters each.
    """
    at = [question, *by]
    first = ranked.where(F.col("rank") <= top)
    used = F.coalesce(F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(*at).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    paid = first.withColumn("__room", F.lit(budget) - used).withColumn("a_end", F.col("start") + F.least(F.col("end") - F.col("start"), F.greatest(F.col("__room"), F.lit(0))))
    wanted = gold.where("spans is not null").select(question, F.col(key).alias("__key"), F.posexplode("spans").alias("__n", "s")).select(question, "__key", "__n", F.col("s.start").alias("b_start"), F.col("s.end").alias("b_end"))
    total = wanted.groupBy(question).agg(F.sum(F.col("b_end") - F.col("b_start")).alias("__total"))
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    hits = first.join(wanted, question).where((F.col(key) == F.col("__key")) & (shared >= F.least(F.lit(HIT_CHARS), F.col("b_end") - F.col("b_start"))))
    best = hits.groupBy(*at).agg(F.min("rank").alias("__rank"))
    a = paid.where("a_end > start").select(*at, F.col(key).alias("__key"), F.col("start").alias("a_start"), "a_end")
    inside = overlaps(a, wanted, [question, "__key"], GRID).select(*at, "__n", F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"))
    held = covered(inside, [*at, "__n"], "s", "e").groupBy(*at).agg(F.sum("covered").alias("__held"))
    asked = ranked.select(*at).distinct().join(total, question)
    rank = F.col("__rank")
    found = asked.join(best, at, "left").join(held, at, "left")
    return found.select(
        *at, F.coalesce((rank == 1).cast("int"), F.lit(0)).alias("hit1"), F.coalesce((rank <= top).cast("int"), F.lit(0)).alias("hit5"), F.coalesce(1 / rank, F.lit(0.0)).alias("mrr5"),
        F.when(F.col("__total") > 0, F.coalesce("__held", F.lit(0)) / F.col("__total")).otherwise(0.0).alias("coverage"),
    )


def side_by_side(results: DataFrame, names: DataFrame, name: str, way: str, ways: list[str], metrics: list[str]) -> DataFrame:
    """One row for each name, those without questions included: questions, status, and each way's mean of each metric as ``<way>_<metric>``."""
    means = results.groupBy(name).pivot(way, ways).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))
    count = F.coalesce(F.col(f"{ways[0]}_n"), F.lit(0))
    joined = names.select(name).distinct().join(means, name, "left")
    return joined.select(name, count.alias("questions"), F.when(count > 0, "evaluated").otherwise("unassessed").alias("status"), *(f"{w}_{m}" for w in ways for m in metrics))


def fit_tokens(chunks: DataFrame, header: str, count: Callable[[str], int], limit: int) -> DataFrame:
    """``chunks`` with those cut again, without loss, whose ``header`` and text have more than ``limit`` tokens by ``count``: each part is the longest that fits. A header that leaves no room raises."""
    names = chunks.columns

    def refine(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                head, text, at = row[header] or "", row["text"], 0
                while at < len(text):
                    size = len(text) - at
                    if count(head + text[at:]) > limit:
                        size = bisect_left(range(1, size), True, key=lambda n: count(head + text[at : at + n]) > limit)
                    if size < 1:
                        raise ValueError("a header leaves no room for a single character")
                    rows.append(row | {"start": row["start"] + at, "end": row["start"] + at + size, "text": text[at : at + size]})
                    at += size
            yield pd.DataFrame(rows, columns=names)

    return chunks.mapInPandas(refine, chunks.schema)
