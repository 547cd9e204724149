"""Ranked lexical search with block-max pruning.

The index is a table of blocks, each a range of consecutive documents of the input: their terms and
term frequencies laid out by document, and for every term the largest share of a score that it
gives to any of them. A query's bound of a block is the sum of its terms' weights times these maxima.
Blocks are scored from the highest bound on, until no bound reaches the score that the
last of the best documents has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import gather, text_slices, utf8
from .hashes import piece_hashes
from .storage import discard, scratch_path, staged, written

#: Documents of a block, and bytes of their texts (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 8, 1 << 18
#: Queries, and terms of all of them, that are searched at a time.
BATCH_QUERIES, BATCH_TERMS = 512, 1 << 18
#: Blocks of each query that the first rounds score; the last round scores all that are left and can matter.
ROUNDS = (8, 64, 512)
#: Queries of all blocks together that a broadcast of visits may hold.
BROADCAST_VISITS = 1 << 20

_TERM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case, starts and ends of their terms, and how many each text has."""
    data, bounds = utf8(texts)
    data = _LOWER[data]
    # one byte that is in no term stands between texts
    term = np.insert(_TERM[data], bounds[1:], False) if len(bounds) > 1 else _TERM[data]
    change = np.flatnonzero(np.diff(np.concatenate([[False], term, [False]]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    breaks = bounds[1:] + np.arange(len(bounds) - 1)
    text = np.searchsorted(breaks, starts)
    return data, starts - text, ends - text, np.bincount(text, minlength=len(bounds) - 1)


def term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and by text and term: the text, the term's number and its frequency; then how many terms each text has."""
    data, starts, ends, sizes = term_runs(texts)
    one, two = piece_hashes(data, starts, ends)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    first = order[new]
    lengths = (ends - starts)[first]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    letters = np.ascontiguousarray(gather(data, starts[first], lengths)) if len(first) else data[:0]
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters))
    pair, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(first)) + code, return_counts=True)
    return terms, pair // max(1, len(first)), pair % max(1, len(first)), count, sizes


def shares(tf: np.ndarray, n: np.ndarray, held: int, length: int) -> np.ndarray:
    """What a term of weight one gives to documents of ``n`` terms that hold it ``tf`` times."""
    m = 50 + (50 * n * held) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class SearchIndex:
    """``blocks``: block, docs, sizes, upto, ids, tfs, terms, dfs, peaks. ``held`` documents have a term, ``length`` in all."""

    blocks: DataFrame
    held: int
    length: int


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> SearchIndex:
    """Index every row of ``docs`` under ``path``.

    A row of the table is a block of consecutive rows of a task: docs (ids), sizes (terms of each), upto (where each one's
    postings end), ids and tfs (postings: number of the term in the block, and frequency), terms, dfs (documents of the block
    that hold each) and peaks (the most it gives to one of them). Nothing is shuffled. A text that is null or has no
    term is in the index and never found. Two counts reach the driver.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = length = 0
        for batch in text_slices(batches, "text"):
            sizes = term_runs(batch["text"])[3]
            held, length = held + int((sizes > 0).sum()), length + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([length], pa.int64())], names=["held", "length"])

    stats = rows.select("text").mapInArrow(count, "held long, length long").agg(F.sum("held").alias("held"), F.sum("length").alias("length")).first()
    held, length = stats["held"] or 0, stats["length"] or 0

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, "text", BLOCK_BYTES):
            for at in range(0, part.num_rows, block_docs):
                batch = part.slice(at, block_docs)
                terms, text, term, tf, sizes = term_counts(batch["text"])
                peaks = np.zeros(len(terms), np.int64)
                np.maximum.at(peaks, term, shares(tf, sizes[text], held, length))
                columns = [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch["id"]),
                    _lists(sizes, pa.int32()),
                    _lists(np.cumsum(np.bincount(text, minlength=batch.num_rows)), pa.int32()),
                    _lists(term, pa.int32()),
                    _lists(tf, pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                    _lists(np.bincount(term, minlength=len(terms)), pa.int32()),
                    _lists(peaks, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", "sizes", "upto", "ids", "tfs", "terms", "dfs", "peaks"])
                block += 1

    schema = f"block long, docs array<{kind}>, sizes array<int>, upto array<int>, ids array<int>, tfs array<int>, terms array<string>, dfs array<int>, peaks array<int>"
    blocks = rows.mapInArrow(build, schema)
    blocks.write.parquet(path)
    return SearchIndex(docs.sparkSession.read.schema(blocks.schema).parquet(path), held, length)


@dataclass(frozen=True)
class _Batch:
    """Queries that are searched together: their terms, and for each query which of them it has."""

    vocabulary: list[str]
    upto: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.upto) - 1

    def of(self, query: int) -> np.ndarray:
        return self.terms[self.upto[query] : self.upto[query + 1]]


def _blocks(batches: Iterable[pa.RecordBatch], own: _Batch) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each row of blocks, and which term of the batch each of its terms is, -1 for none."""
    known = pa.array(own.vocabulary, pa.string())
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch, n, np.asarray(pc.fill_null(pc.index_in(batch["terms"][n].values, known), -1), np.int64)


def _array(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    return np.asarray(batch[name][n].values, np.int64)


def _batches(queries: DataFrame, text_col: str) -> Iterator[tuple[list[int], _Batch]]:
    """Numbered queries in batches of bounded size, a batch at a time on the driver."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            for n in range(batch.num_rows):
                terms = term_counts(batch["text"].slice(n, 1))[0]
                if len(terms):
                    yield pa.RecordBatch.from_arrays([batch["query"].slice(n, 1), pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)], names=["query", "terms"])

    names, found = [], []

    def batch() -> tuple[list[int], _Batch]:
        vocabulary = sorted({t for terms in found for t in terms})
        number = {t: n for n, t in enumerate(vocabulary)}
        return names, _Batch(vocabulary, np.cumsum([0, *map(len, found)]), np.array([number[t] for terms in found for t in terms], np.int64))

    rows = staged(queries.select("query", F.col(text_col).alias("text")).mapInArrow(split, "query long, terms array<string>"), "queries")
    for r in rows.toLocalIterator():
        if found and (len(found) == BATCH_QUERIES or sum(map(len, found)) + len(r["terms"]) > BATCH_TERMS):
            yield batch()
            names, found = [], []
        names.append(r["query"])
        found.append(r["terms"])
    if found:
        yield batch()


def _weights(index: SearchIndex, own: _Batch) -> np.ndarray:
    """Weight of each term of the batch, by the number of documents of all blocks that hold it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own.vocabulary), np.int64)
        for batch, n, term in _blocks(batches, own):
            total[term[term >= 0]] += _array(batch, "dfs", n)[term >= 0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    df = np.zeros(len(own.vocabulary), np.int64)
    for r in index.blocks.select("terms", "dfs").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * index.held + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _bounds(index: SearchIndex, own: _Batch) -> DataFrame:
    """query, block and bound, where it is above zero."""

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = np.repeat(np.arange(len(own)), np.diff(own.upto))
        for batch, n, term in _blocks(batches, own):
            most = np.zeros(len(own.vocabulary) + 1, np.int64)
            most[term] = _array(batch, "peaks", n)  # -1 is a place of its own
            total = np.zeros(len(own), np.int64)
            np.add.at(total, query, (most[:-1] * own.weights)[own.terms])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), batch["block"][n].as_py(), np.int64)), pa.array(total[at])], names=["query", "block", "bound"])

    return index.blocks.select("block", "terms", "peaks").mapInArrow(bound, "query long, block long, bound long")


def _scored(index: SearchIndex, own: _Batch, visits: DataFrame, k: int) -> DataFrame:
    """query, doc and score of the best ``k`` documents, and all that equal the last of them, of every block and query of ``visits``."""
    kind = index.blocks.schema["docs"].dataType.elementType.simpleString()
    held_docs, length = index.held, index.length

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, term in _blocks(batches, own):
            upto, sizes = _array(batch, "upto", n), _array(batch, "sizes", n)
            ids, tf = _array(batch, "ids", n), _array(batch, "tfs", n)
            on = np.flatnonzero(term[ids] >= 0)
            text = np.searchsorted(upto, on, side="right")
            ids = ids[on]
            given = shares(tf[on], sizes[text], held_docs, length) * own.weights[term[ids]]
            where = np.searchsorted(text, np.arange(len(sizes) + 1))
            place = np.full(len(own.vocabulary), -1, np.int64)
            place[term[term >= 0]] = np.flatnonzero(term >= 0)
            queries, docs, scores = [], [], []
            for query in _array(batch, "queries", n).tolist():
                held = np.zeros(len(term) + 1, bool)
                held[place[own.of(query)]] = True
                held[-1] = False
                upward = np.concatenate([[0], np.cumsum(given * held[ids])])
                total = upward[where[1:]] - upward[where[:-1]]
                at = np.flatnonzero(total)
                if len(at) > k:
                    at = at[total[at] >= np.partition(total[at], len(at) - k)[len(at) - k]]
                queries.append(np.full(len(at), query))
                docs.append(at)
                scores.append(total[at])
            columns = [pa.array(np.concatenate(queries)), batch["docs"][n].values.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "doc", "score"])

    by_block = staged(visits.groupBy("block").agg(F.collect_list("query").alias("queries")), "visits")
    size = by_block.agg(F.sum(F.size("queries"))).first()[0] or 0
    side = F.broadcast(by_block) if size <= BROADCAST_VISITS else by_block
    return index.blocks.select("block", "docs", "sizes", "upto", "ids", "tfs", "terms").join(side, "block").drop("block").mapInArrow(score, f"query long, doc {kind}, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search_batch(spark: SparkSession, index: SearchIndex, own: _Batch, k: int, rounds: tuple[int, ...]) -> tuple[DataFrame, list[int], int]:
    own = _Batch(own.vocabulary, own.upto, own.terms, _weights(index, own))
    bounds, path = written(_bounds(index, own), "bounds")
    lowest = [(q, 1, 1 << 62, -1) for q in range(len(own))]  # query, bound that counts, bound and block of the last visit
    hits, visited = None, []
    for most in (*rounds, None):
        # one row a query of the batch
        mark = F.broadcast(spark.createDataFrame(lowest, "query long, least long, last_bound long, last_block long"))
        after = (F.col("bound") < F.col("last_bound")) | ((F.col("bound") == F.col("last_bound")) & (F.col("block") > F.col("last_block")))
        visits = bounds.join(mark, "query").where(after & (F.col("bound") >= F.col("least"))).select("query", "block", "bound")
        if most is not None:
            by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
            visits = visits.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= most).drop("n")
        visits, seen = written(visits, "round")
        last = {r["query"]: r for r in visits.groupBy("query").agg(F.min(F.struct(F.col("bound"), -F.col("block"))).alias("end"), F.count("*").alias("n")).collect()}
        visited.append(sum(r["n"] for r in last.values()))
        if last:
            found = _scored(index, own, visits, k)
            hits = staged(_best(found if hits is None else found.unionByName(hits.drop("rank")), k), "hits")
        discard(spark, seen)
        if most is None or not last:
            break
        kth = {r["query"]: r["score"] for r in hits.where(F.col("rank") == k).collect()}
        lowest = [(q, max(1, kth.get(q, 1)), last[q]["end"][0], -last[q]["end"][1]) if q in last else (q, 1 << 62, 0, 0) for q in range(len(own))]
    pairs = bounds.count()
    discard(spark, path)
    return hits, visited, pairs


def search_index(index: SearchIndex, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", rounds: tuple[int, ...] = ROUNDS, report: list | None = None) -> DataFrame:
    """For every row of ``queries`` its ``k`` best documents of score above zero: ``id_col``, rank, ``doc_col``, score.

    A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; a document's score sums, over the distinct terms of the
    query, weight times ``(1000000000 * tf) div (1000 * tf + 20 * m)``. Equal scores go by ascending document id, null last.
    A block is left out only where its bound is below the score of a query's k-th document so far, so results are
    those of scoring everything. ``report`` gets (blocks scored in each round, blocks of bounds above zero) for each batch.

    A query whose text is null or has no term, or whose terms no document holds, gives no rows. Queries that repeat an id
    are ranked each by itself; documents that repeat an id are ranked each. An empty index or table of queries gives no
    rows. Queries are searched ``BATCH_QUERIES`` at a time, each batch against all blocks.
    """
    spark = queries.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    doc_kind = index.blocks.schema["docs"].dataType.elementType.simpleString()
    numbered = staged(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("query")), "numbered")
    out = spark.createDataFrame([], f"id {kind}, rank int, doc {doc_kind}, score long")
    for names, own in _batches(numbered, "text"):
        hits, visited, pairs = _search_batch(spark, index, own, k, rounds)
        if report is not None:
            report.append((visited, pairs))
        if hits is not None:
            number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "query long, name long"))  # one batch
            named = hits.join(number, "query").join(numbered.select(F.col("query").alias("name"), "id"), "name")
            out = out.unionByName(named.select("id", "rank", "doc", "score"))
    return out.select(F.col("id").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """:func:`search_index` on an index of ``docs`` in the shared folder."""
    path = scratch_path(docs.sparkSession, "search")
    return search_index(build_index(docs, path, id_col, text_col), queries, k, query_col, query_text_col, id_col)


def search_oracle(k: int = 50) -> str:
    """DuckDB SQL for :func:`search_documents` over tables documents and benchmark."""
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as row, doc_id, {words("text")} as words from documents),
s as (select count(*) held, coalesce(sum(len(words)), 0)::bigint length from d where len(words) > 0),
p as (select row, doc_id, n, term, count(*) tf from (select row, doc_id, len(words) n, unnest(words) term from d) group by all),
q as (select distinct item, item_id, term from (select row_number() over () item, item_id, unnest({words("text")}) term from benchmark)),
w as (select term, floor(1000 * ln((2 * held + 2) / (2 * count(*) + 1)::double))::bigint w from p, s where term in (select term from q) group by term, held),
r as (select item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * held) // length))))::bigint score
  from q join w using (term) join p using (term), s group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item order by score desc, doc_id)::int rank from r where score > 0) where rank <= {k}"""
