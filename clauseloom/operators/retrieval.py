"""Retrieval: BM25, exact vector search, fused and filtered rankings, groups and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..tables import discard
from .cells import build_cells, links_cells, top_cells
from .postings import Postings, asked_terms, build_postings, score_all
from .term_blocks import build_blocks, top_blocks

# Fixed values of the rankings.
RRF_K, BM25_WEIGHT, CANDIDATES = 60, 0.5, 50
DIVERSE_MIN, DIVERSE_SHARE = 2, 5
LIST_PIECES, EXPAND_ALL = 3, 8


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, allowed: Column | None = None) -> DataFrame:
    """query_key, key and score of every document that shares a term with a query.

    A query's terms count once. Statistics are those of all documents, also where ``allowed``, over
    columns of ``docs``, restricts the results. Texts are tokenised once; only postings of query terms are read again.
    """
    index, on = bm25_index(docs, key, text, allowed)
    return score_all(index, asked_terms(index, queries, query_key, query_text), query_key, on)


def bm25_index(docs: DataFrame, key: str, text: str, allowed: Column | None = None) -> tuple[Postings, Column | None]:
    """An index of ``docs``, and ``allowed`` as a condition on its postings."""
    if allowed is None:
        return build_postings(docs, key, text), None
    return build_postings(docs.withColumn("__on", F.coalesce(allowed, F.lit(False))), key, text, ("__on",)), F.col("__on")


def bm25_top(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int, allowed: Column | None = None, by: tuple[str, ...] = (), among: str | None = None) -> DataFrame:
    """The ``k`` best of :func:`bm25` for each query, with rank, where ``by`` names columns in each of their combinations by itself, or, with ``among`` (a column of ``queries``, see :func:`top_blocks`), in all of certain combinations together; no posting is shuffled, and the index goes when the results are written."""
    index = build_blocks(docs, key, text, allowed, by)
    found = top_blocks(index, queries, query_key, query_text, k, among=among)
    discard(index.blocks)
    return found


def top(scores: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """The ``k`` best of each query with rank from 1; equal scores by key."""
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(key)))
    return scores.withColumn("rank", order.cast("long")).where(F.col("rank") <= k)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", same: str | None = None, cells: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, key, similarity and rank of the ``k`` most alike others by exact cosine (to ``digits`` places); with ``same``, among those that share this column. Only cells that can hold one are searched."""
    return top_cells(build_cells(vectors, key, vector, same, cells), queries, k, key, vector, digits=digits)


def vector_links(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """query_id, key and similarity of all others whose exact cosine is ``least`` or more."""
    return links_cells(build_cells(vectors, key, vector, None, cells), queries, least, key, vector)


def vector_counts(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", same: str | None = None, cells: int | None = None, digits: int | None = None) -> DataFrame:
    """query_id, candidates and best: how many others each query is compared with, and the key of the most alike, the smallest of equals."""
    own = [same] if same else []
    counts = vectors.where(F.col(vector).isNotNull()).groupBy(*own, F.size(vector).alias("__size")).agg(F.count("*").alias("__n"))
    asked = queries.select(F.col(key).alias("query_id"), F.size(vector).alias("__size"), *own)
    held = asked.join(vectors.select(F.col(key).alias("query_id"), F.lit(1).alias("__self")).distinct(), "query_id", "left").join(counts, ["__size", *own])
    best = vector_top(vectors, queries, 1, key, vector, same, cells, digits).select("query_id", F.col(key).alias("best"))
    return held.select("query_id", (F.col("__n") - F.coalesce("__self", F.lit(0))).alias("candidates")).join(best, "query_id")


def fuse(runs: list[tuple[DataFrame, float]], query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked runs (query, key, rank from 1) with weights: query, key, fused, rank."""
    each = [r.select(query, key, (F.lit(w) / (k + F.col("rank"))).alias("part"), F.lit(n).alias("run"), "rank") for n, (r, w) in enumerate(runs)]
    both = each[0]
    for other in each[1:]:
        both = both.unionByName(other)
    summed = both.groupBy(query, key).agg(F.sum("part").alias("fused"), F.min(F.struct("run", "rank")).alias("seen"))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("fused", 12)), "seen")
    return summed.select(query, key, "fused", F.row_number().over(order).cast("long").alias("rank"))


def merge_equals(ranked: DataFrame, query: str, key: str, content: str, k: int) -> DataFrame:
    """The first of each content in rank order with the others as also_in, for the ``k`` best contents."""
    own = Window.partitionBy(query, content)
    rows = ranked.withColumn("lead", F.min("rank").over(own))
    others = F.array_sort(F.collect_list(F.when(F.col("rank") != F.col("lead"), F.col(key))))
    groups = rows.groupBy(query, content, "lead").agg(F.min_by(key, "rank").alias(key), others.alias("also_in"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("lead")).cast("long")).where(F.col("place") <= k).select(query, key, "place", "also_in")


def diversify(ranked: DataFrame, query: str, group: str, k: int) -> DataFrame:
    """At most ``max(2, k // 5)`` rows of each group, groups in order of their best row: adds group_order."""
    most = max(DIVERSE_MIN, k // DIVERSE_SHARE)
    within = Window.partitionBy(query, group)
    rows = ranked.withColumn("nth", F.row_number().over(within.orderBy("rank"))).withColumn("best", F.min("rank").over(within)).where(F.col("nth") <= most)
    return rows.withColumn("group_order", F.dense_rank().over(Window.partitionBy(query).orderBy("best")).cast("long")).drop("nth", "best")


def neighbours(pieces: DataFrame, hits: DataFrame, group: str, piece: str) -> DataFrame:
    """Pieces to show of each hit group: all of a small one, else the hits and those next to them; gap says that pieces before were left out."""
    sized = pieces.join(hits.select(group).distinct(), group, "left_semi").withColumn("pieces", F.count("*").over(Window.partitionBy(group)))
    near = hits.select(group, F.explode(F.array(*(F.col(piece) + d for d in (-1, 0, 1)))).alias(piece)).distinct().withColumn("near", F.lit(True))
    shown = sized.join(near, [group, piece], "left").where((F.col("pieces") <= EXPAND_ALL) | F.col("near")).drop("near")
    return shown.withColumn("gap", F.coalesce(F.col(piece) - F.lag(piece).over(Window.partitionBy(group).orderBy(piece)) > 1, F.lit(False)))


def upsert_plan(stored: DataFrame, wanted: DataFrame, key: str, digest: str) -> DataFrame:
    """What brings an index from ``stored`` to ``wanted``: key and action (insert, embed, metadata or delete)."""
    old, new = stored.select(key, F.col(digest).alias("old")), wanted.select(key, F.col(digest).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "embed").otherwise("metadata")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def vanished_terms(queries: DataFrame, query_key: str, query_text: str, current: DataFrame, past: DataFrame) -> DataFrame:
    """query_key and term of query terms that texts (column term) of the past have and current ones lack."""
    terms = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    return terms.join(past.select("term").distinct(), "term", "left_semi").join(current.select("term").distinct(), "term", "left_anti")


def holding(docs: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """key and passage_key of documents that hold a passage whole.

    A passage's inner words are words of any text that holds it, so three of them in a row (or one, of passages of three or
    four words) lead to the texts in question, which are then compared. Only passages of one or two words meet all texts.
    """
    words = F.filter(F.split(F.col(passage), r"[ \n\t]+"), lambda w: w != "")
    asked = passages.where(F.length(passage) > 0).select(passage_key, F.col(passage).alias("__passage"), words.alias("__w"))
    whole = F.contains("__text", F.col("__passage"))
    texts = docs.select(key, F.col(text).alias("__text"), F.filter(F.split(F.col(text), r"[ \n\t]+"), lambda w: w != "").alias("__w"))
    hashed = lambda a, b, c: F.xxhash64(a, b, c)
    n = F.size("__w")
    at = lambda i: F.element_at("__w", i)
    found = None
    for width, enough in ((3, n >= 5), (1, n.between(3, 4))):
        some = asked.where(enough).select(passage_key, "__passage", (hashed(at(2), at(3), at(4)) if width == 3 else F.xxhash64(at(2))).alias("__anchor"))
        rows = F.slice("__w", 1, F.greatest(n - (width - 1), F.lit(0)))
        anchors = F.transform(rows, lambda w, i: hashed(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)) if width == 3 else F.xxhash64(w))
        pairs = texts.select(key, F.explode(F.array_distinct(anchors)).alias("__anchor")).join(some, "__anchor").select(key, passage_key).distinct()
        met = pairs.join(some.select(passage_key, "__passage"), passage_key).join(texts.select(key, "__text"), key).where(whole).select(key, passage_key)
        found = met if found is None else found.unionByName(met)
    short = asked.where(n < 3).select(passage_key, "__passage")
    return found.unionByName(texts.join(short, whole).select(key, passage_key)).distinct()
