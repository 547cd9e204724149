"""Exact vector search by cells: blocks of vectors that no near one can be in are left out.

Unit vectors are dealt to the nearest of some centres, and within a cell to blocks of like distance from its centre.
By the triangle inequality on angles, a vector within reach of a query lies about as far from the centre as the query
does; so a cell's blocks of other distances need not be read. What a query's nearest cell holds sets its reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Vectors of a block, about, and centres at most.
BLOCK, CENTRES = 1024, 1024
#: Rounds of k-means and vectors that they take at most (those whose keys hash lowest).
ROUNDS, SAMPLE = 5, 50_000
#: Queries that meet a block at a time.
QUERIES = 512
#: Blocks differ in angle by this much, and what rounding may add to one.
STEP, SLACK = 0.1, 1e-6


@dataclass(frozen=True)
class Cells:
    """``blocks``: size, cell, low, high (angles to the centre), block, keys, rows (unit vectors) and ``same``; ``centres`` by size of vector."""

    blocks: DataFrame
    centres: dict[int, np.ndarray]
    same: str | None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _by_size(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one size of vector each, with unit vectors."""
    for batch in batches:
        sizes = np.asarray(batch["size"])
        for size in np.unique(sizes).tolist():
            part = batch.take(pa.array(np.flatnonzero(sizes == size)))
            yield size, part, _unit(_matrix(part["vector"]))


def _usable(vectors: DataFrame, key: str, vector: str, same: str | None) -> DataFrame:
    """key, size, vector and same of vectors that have components, all of them finite. Of zero ones every cosine is zero."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.size(v).alias("size"), v.alias("vector"), (F.col(same).cast("long") if same else F.lit(0).cast("long")).alias("same"))
    return rows.where((F.col("size") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def train_centres(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centres by size of vector: ``count`` at most, ``ROUNDS`` rounds of spherical k-means on ``SAMPLE`` vectors at most. The driver holds the centres."""
    chosen = stored(rows.orderBy(F.xxhash64("key", "vector")).limit(SAMPLE).select("size", "vector"))
    centres: dict[int, np.ndarray] = {}
    for r in chosen.withColumn("n", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("vector", F.lit(1))))).where(F.col("n") <= count).orderBy("size", "n").collect():
        centres.setdefault(r["size"], []).append(r["vector"])
    centres = {size: _unit(np.array(c)) for size, c in centres.items()}
    if count == 1:
        return centres
    for _ in range(ROUNDS):

        def sums(batches: Iterable[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            for size, _, unit in _by_size(batches):
                near = (unit @ centres[size].T).argmax(axis=1)
                for cell in np.unique(near).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([cell]), pa.array([unit[near == cell].sum(axis=0).tolist()])], names=["size", "cell", "total"])

        moved = chosen.mapInArrow(sums, "size int, cell long, total array<double>").select("size", "cell", F.posexplode("total").alias("i", "x")).groupBy("size", "cell", "i").agg(F.sum("x").alias("x"))
        centres = {size: c.copy() for size, c in centres.items()}
        for r in moved.groupBy("size", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).collect():
            centres[r["size"]][r["cell"]] = _unit(np.array([[c["x"] for c in r["c"]]]))[0]
    return centres


def _placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest centre and the angle to it."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, unit in _by_size(batches):
            if size not in centres:
                continue
            cosine = unit @ centres[size].T
            near = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(near)), near], -1, 1))
            yield pa.RecordBatch.from_arrays([part["key"], part["size"], part["same"], pa.array(near), pa.array(angle), pa.array([u.tobytes() for u in unit], pa.binary())], names=["key", "size", "same", "cell", "angle", "unit"])

    return rows.select("key", "size", "same", "vector").mapInArrow(place, "key long, size int, same long, cell long, angle double, unit binary")


def _packed(rows: DataFrame, by: list[str], extra: list, keep: str) -> DataFrame:
    """Keys, rows and same of each group of ``by``, whose sizes are bounded, as arrays."""
    listed = F.array_sort(F.collect_list(F.struct("key", "same", "unit")))
    return rows.groupBy(*by).agg(listed.alias("r"), *extra).select(*by, *(keep.split()), F.transform("r", lambda r: r["key"]).alias("keys"), F.transform("r", lambda r: r["same"]).alias("sames"), F.transform("r", lambda r: r["unit"]).alias("rows"))


def build_cells(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", same: str | None = None, cells: int | None = None) -> Cells:
    """An index of all vectors. A cell that holds a third of them is many blocks, by angle and key. Vectors that are null or empty, or have null or non-finite components are in none."""
    rows = _usable(vectors, key, vector, same)
    count = cells or max(1, min(CENTRES, rows.count() // BLOCK))
    centres = train_centres(rows, count)
    placed = stored(_placed(rows, centres).withColumn("ring", F.floor(F.col("angle") / STEP)))
    place = ["size", "cell", "ring"]
    parts = placed.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(parts, place).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    blocks = _packed(dealt, [*place, "part"], [F.min("angle").alias("low"), F.max("angle").alias("high")], "low high").drop("ring", "part")
    return Cells(stored(blocks.withColumn("block", F.monotonically_increasing_id())), centres, same)


def _near(index: Cells, queries: DataFrame, visits: DataFrame, k: int | None, digits: int | None = None) -> DataFrame:
    """query_id, key and similarity (to ``digits`` places) of each block and the queries that visit it: the ``k`` best of both, or all from the query's ``least`` on."""
    parts = F.pmod(F.xxhash64("key"), F.ceil(F.count("*").over(Window.partitionBy("block")) / QUERIES))
    asked = visits.join(queries.select("key", "same", "unit", "least"), "key").withColumn("part", parts)
    listed = F.collect_list(F.struct("key", "same", "unit", "least")).alias("asked")
    met = asked.groupBy("block", "part").agg(listed).join(index.blocks.select("block", "keys", "sames", "rows"), "block").select("asked", "keys", "sames", "rows")
    same = index.same is not None

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                asked = batch["asked"][n].values
                qk, qs = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("key", "same"))
                least = asked.field("least").to_numpy(zero_copy_only=False)
                dk = np.asarray(batch["keys"][n].values)
                q, d = (np.frombuffer(b"".join(x.to_pylist()), np.float64).reshape(len(x), -1) for x in (asked.field("unit"), batch["rows"][n].values))
                sim = q @ d.T
                if digits is not None:
                    sim = np.copysign(np.floor(np.abs(sim) * 10.0**digits + 0.5) / 10.0**digits, sim) + 0.0
                out = qk[:, None] == dk[None, :]
                if same:
                    other = batch["sames"][n].values.to_numpy(zero_copy_only=False)
                    out |= ~(qs[:, None] == other[None, :])
                sim[out] = -np.inf
                if k is None:
                    i, j = np.nonzero(sim >= least[:, None])
                else:
                    order = np.lexsort((np.broadcast_to(dk, sim.shape), -sim), axis=1)[:, :k]
                    i, at = np.nonzero(np.isfinite(np.take_along_axis(sim, order, axis=1)))
                    j = order[i, at]
                yield pa.RecordBatch.from_arrays([pa.array(qk[i]), pa.array(dk[j]), pa.array(sim[i, j])], names=["query_id", "key", "similarity"])

    return met.mapInArrow(multiply, "query_id long, key long, similarity double")


def _asked(index: Cells, queries: DataFrame, key: str, vector: str) -> DataFrame:
    return stored(_placed(_usable(queries, key, vector, index.same), index.centres))


def _visits(index: Cells, asked: DataFrame) -> DataFrame:
    """key and block of all blocks that may hold a vector whose cosine with a query is its ``least`` or more (null: all)."""
    centres = index.centres

    def angles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["size"])
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                unit = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float64).reshape(part.num_rows, size)
                angle = np.arccos(np.clip(unit @ centres[size].T, -1, 1))
                least = part["least"].to_numpy(zero_copy_only=False)
                reach = np.where(np.isnan(least), math.pi, np.arccos(np.clip(least, -1, 1))) + SLACK
                row, cell = (x.ravel() for x in np.indices(angle.shape))
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(row)), part["size"].take(pa.array(row)), pa.array(cell), pa.array(angle.ravel()), pa.array(reach[row])], names=["key", "size", "cell", "angle", "reach"])

    rings = asked.select("key", "size", "unit", F.col("least").cast("double")).mapInArrow(angles, "key long, size int, cell long, angle double, reach double")
    met = rings.join(index.blocks.select("size", "cell", "low", "high", "block"), ["size", "cell"])
    return met.where((F.col("angle") - F.col("reach") <= F.col("high")) & (F.col("angle") + F.col("reach") >= F.col("low"))).select("key", "block")


def top_cells(index: Cells, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", report: list | None = None, digits: int | None = None) -> DataFrame:
    """query_id, ``key``, similarity and rank of the ``k`` most alike others by exact cosine, equal ones by key; with ``same``, among those that share it.

    With ``digits`` cosines count to so many places: copies of a vector, whose cosines a product may round differently, are equal then.

    A query's own cell is searched first; then the blocks within the angle of the k-th best there. Queries that are no usable vectors have no
    results, and vectors of other sizes are none. ``report`` gets the pairs of query and block that were visited, and how many there are.
    """
    asked = _asked(index, queries, key, vector)
    best = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")).cast("long")).where(F.col("rank") <= k)
    own = asked.join(index.blocks.select("size", "cell", "block"), ["size", "cell"]).select("key", "block")
    first = stored(best(_near(index, asked.withColumn("least", F.lit(-1.0)), own, k, digits)))
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("key"), (F.col("similarity") - (0.0 if digits is None else 10.0**-digits)).alias("least"))
    known = asked.join(least, "key", "left")
    visits = stored(_visits(index, known))
    if report is not None:
        report.append((visits.count(), asked.count() * index.blocks.count()))
    found = best(_near(index, known, visits, k, digits))
    return found.select("query_id", F.col("key").alias(key), "similarity", "rank")


def links_cells(index: Cells, queries: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, ``key`` and similarity of all others whose exact cosine is ``least`` or more."""
    asked = _asked(index, queries, key, vector).withColumn("least", F.lit(float(least)))
    return _near(index, asked, _visits(index, asked), None).withColumnRenamed("key", key)
