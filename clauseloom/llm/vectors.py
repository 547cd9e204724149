"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label are turned so that the directions of most variance come first. Linked unit
vectors lie within ``sqrt(2 - 2 * threshold)`` in every direction, so a grid of that width over the
two leading ones says which vectors can meet; a grid cell is cut into tiles of bounded size. A
pair of tiles first multiplies the leading dimensions; what the rest can add is bounded by the
product of the suffix norms, and only pairs that can still reach the threshold go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_components
from .storage import staged

#: Vectors in a tile, about.
TILE = 1024
#: Leading dimensions of the first product, and the steps after it.
STEP = 16
#: Pairs of a strip of two tiles, and entries of pairs of vectors that are multiplied at a time.
STRIP, ENTRIES = 1 << 16, 1 << 20


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Which rows hold a usable vector, these vectors' sizes, and their components as bytes: in single precision where that loses nothing, else in double."""
    right, sizes, raws = [], [], []
    for n, v in enumerate(column):
        x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, dtype=np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            continue
        right.append(n)
        sizes.append(len(x))
        x = x + 0.0
        with np.errstate(over="ignore", under="ignore"):
            narrow = x.astype(np.float32)
        raws.append((narrow if (narrow == x).all() else x).tobytes())
    return np.array(right, np.int64), np.array(sizes, np.int64), raws


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is first scaled by its largest component, so that no square overflows or vanishes."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rows_of(rows: list[bytes], size: int) -> np.ndarray:
    """Vectors of one size in double precision."""
    if len({len(r) for r in rows}) > 1:
        return np.stack([np.frombuffer(r, f"<f{len(r) // size}") for r in rows]).astype(np.float64)
    joined = b"".join(rows)
    return np.frombuffer(joined, f"<f{len(joined) // max(1, len(rows) * size)}").reshape(len(rows), size).astype(np.float64)


def _moments(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of outer products of all unit vectors, all of one size: dimensions squared, whatever the number of rows."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_rows_of(batch["raw"].to_pylist(), size))
            total = unit.T @ unit if total is None else total + unit.T @ unit
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    cells = rows.select("raw").mapInArrow(add, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = r["x"]
    return out


def compare_tiles(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of ``a`` and ``b`` whose dot product may reach ``threshold``, up to rounding; i < j where both are one tile. Rows are unit vectors, leading dimensions first.

    A strip of ``a`` faces ``b`` at a time, so that at most ``STRIP`` pairs (a row's, if ``b`` has more) and ``ENTRIES`` entries of them are held, however many are alike.
    """
    size, slack = a.shape[1], 1e-9
    rest = lambda x, at: np.sqrt(np.maximum((x[:, at:] ** 2).sum(axis=1), 0))
    steps = [*range(min(STEP, size), size, STEP), size]
    left, right = ({at: rest(x, at) for at in steps} for x in (a, b))
    at = steps[0]
    step = max(1, STRIP // max(1, len(b)))
    for first in range(0, len(a), step):
        strip = slice(first, first + step)
        product = a[strip, :at] @ b[:, :at].T
        can = product + left[at][strip, None] * right[at][None, :] >= threshold - slack
        if same:
            can &= np.arange(len(b))[None, :] > np.arange(first, first + len(product))[:, None]
        i, j = np.nonzero(can)
        total = product[i, j]
        i = i + first
        for low, high in zip(steps, steps[1:]):
            if not len(i):
                break
            total = total + _dots(a[:, low:high], b[:, low:high], i, j)
            on = total + left[high][i] * right[high][j] >= threshold - slack
            i, j, total = i[on], j[on], total[on]
        if len(i):
            yield i, j


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows ``i`` of ``a`` with rows ``j`` of ``b``."""
    out, step = np.empty(len(i)), max(1, ENTRIES // a.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("nd,nd->n", a[i[at : at + step]], b[j[at : at + step]])
    return out


def tile_links(raws: list[np.ndarray], copies: list[np.ndarray], turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a tile, or of two tiles on end, counted by ``copies`` of its partners, and the first vector that links inside reach. Vectors as given are what decides."""
    same, units = len(raws) == 1, [_unit(r) for r in raws]
    weight, shift = np.concatenate(copies), 0 if same else len(raws[0])
    links, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for i, j in compare_tiles(units[0] @ turn, units[-1] @ turn, threshold, same):
        exact = _dots(units[0], units[-1], i, j) >= threshold
        i, j = i[exact], j[exact] + shift
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        held = np.flatnonzero(root != np.arange(len(root)))
        root = local_components(len(root), np.concatenate([held, i]), np.concatenate([root[held], j]))
    return links, root


def link_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row for each row of ``vectors``: ``id_col``, n_links (other vectors of cosine ``threshold`` or more among those of the same label), component_id (smallest id that links reach), kept (it is that one).

    Copies within a label are compared once and counted as often as they occur. Each pair of tiles
    sends a count for each vector and the edges of a spanning star, not its pairs. The PCA only
    orders and bounds: what it lets through is decided on the vectors as they are given.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows whose label or id is null,
    link with nothing; such a row is kept. Vectors of different sizes do not link; each size has directions of its own,
    which the driver computes one size at a time. Rows that repeat an id are vectors of their own,
    counted and linked each within its label. An empty table gives no rows. Other columns are not read.
    """
    kind, label = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()

    def raws(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, size, raw = _usable(batch["vector"])
            digests, rows, sizes = ([None] * batch.num_rows for _ in range(3))
            for n, s, x in zip(right.tolist(), size.tolist(), raw):
                digests[n], rows[n], sizes[n] = xxhash.xxh3_128_digest(x), x, s
            columns = [batch["vec_id"], batch["label"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "size", "digest", "raw"])

    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = staged(chosen.mapInArrow(raws, f"vec_id {kind}, label {label}, size long, digest binary, raw binary"), "vectors")
    right = (F.col("digest").isNotNull()) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    members = rows.where(right)
    alone = rows.where(~right).select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    # a node is a distinct vector of a label; ids may be repeated and say nothing
    groups = members.groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("raw").alias("raw"))
    groups = staged(groups.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")

    sizes = [r[0] for r in groups.groupBy("size").count().orderBy("size").collect()]
    turns = {size: np.linalg.eigh(_moments(groups.where(F.col("size") == size), size))[1][:, ::-1] for size in sizes}
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch["size"])
            for size in np.unique(own).tolist():
                part = batch.take(pa.array(np.flatnonzero(own == size)))
                unit = _unit(_rows_of(part["raw"].to_pylist(), size)) @ turns[size][:, :2]
                cell = np.floor(unit / width).astype(np.int32)
                second = cell[:, 1] if cell.shape[1] > 1 else np.zeros(len(cell), np.int32)
                columns = [part["label"], part["size"], part["node"], part["copies"], pa.array(cell[:, 0]), pa.array(second), part["raw"]]
                yield pa.RecordBatch.from_arrays(columns, names=[*cells, "node", "copies", "x", "y", "raw"])

    cells = ["label", "size"]
    placed = groups.select(*cells, "node", "copies", "raw").mapInArrow(place, f"label {label}, size long, node long, copies long, x int, y int, raw binary")
    placed = staged(placed, "placed-vectors")
    cells += ["x", "y"]
    blocks = placed.groupBy(*cells).agg(F.ceil(F.count("*") / tile).alias("blocks"))
    tiled = placed.join(blocks, cells).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def pack(table: pa.Table) -> pa.Table:
        lists = [pa.array([table[c].to_pylist()], kind) for c, kind in (("node", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("raw", pa.list_(pa.binary())))]
        return pa.table([*(table.slice(0, 1)[c] for c in (*cells, "block")), *lists], names=[*cells, "block", "nodes", "copies", "raws"])

    # dealt by the tile, since a cell may hold a third of all vectors
    dealt = tiled.select(*cells, "block", "node", "copies", "raw").repartition(*cells, "block")
    tiles = dealt.groupBy(*cells, "block").applyInArrow(pack, f"label {label}, size long, x int, y int, block long, nodes array<long>, copies array<long>, raws array<binary>")
    tiles = staged(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    index = tiles.select("tile", *cells, "block")
    ahead = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    left = index.select(F.col("tile").alias("a"), "label", "size", F.col("block").alias("a_block"), "x", "y", ahead.alias("d"))
    left = left.select("a", "label", "size", "a_block", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    pairs = left.join(index.withColumnRenamed("tile", "b"), cells).where("not own or a_block <= block").select("a", "b")
    side = lambda c: tiles.select(F.col("tile").alias(c), F.col("size").alias(f"{c}_size"), *(F.col(x).alias(f"{c}_{x}") for x in ("nodes", "copies", "raws")))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch[name][n] for name in batch.schema.names}
                size = row["a_size"].as_py()
                sides = "a" if row["a"].as_py() == row["b"].as_py() else "ab"
                nodes, copies = ([np.asarray(row[f"{c}_{x}"].values) for c in sides] for x in ("nodes", "copies"))
                links, root = tile_links([_rows_of(row[f"{c}_raws"].as_py(), size) for c in sides], copies, turns[size], threshold)
                ids, on = np.concatenate(nodes), links > 0
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(ids[root[on]])], names=["node", "links", "root"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "node long, links long, root long")
    met = staged(met, "links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("root"))
    known = groups.select("label", "digest", "node", "least", "copies").join(links, "node", "left").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("label", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component_id").cast("long").alias("component_id"))
    linked = members.select("vec_id", "label", "digest").join(known, ["label", "digest"])
    return linked.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionAll(alone)


def vector_oracle(threshold: float = 0.98) -> str:
    """DuckDB SQL for :func:`link_vectors` over table embeddings, for small tables."""
    return f"""
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
  and list_bool_and(list_transform(embedding::double[], lambda x: x is not null and isfinite(x))) and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
l as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {threshold}),
r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join l on l.x = r.y),
c as (select x, min(y) component_id from r group by x), n as (select x, count(*) n from l group by x)
select vec_id, coalesce(n.n, 0) n_links, component_id, vec_id = component_id kept from embeddings join c on c.x = vec_id left join n on n.x = vec_id"""
