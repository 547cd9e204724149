"""Links between nodes that share a key, without listing every pair of a bucket.

A filter gives nodes keys so that linked nodes share one. First each bucket is a star around
its smallest node; the links found there merge most of a group of copies. What is left of a bucket
are nodes of different components, which are compared in tiles of bounded size by sketches
that never rule out a link. Only pairs that the sketches let through are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import mix
from .components import connected_components
from .storage import discard, staged, written

#: Nodes in a tile, about, and how many of them face another tile at a time.
TILE, STRIP = 4096, 256
#: Low bits of a key that say which slice its rows met in.
SALT = 12
#: Cells of the bitmap that says which rows are read again.
CELLS = 1 << 23
#: 64-bit words of a parity sketch.
WORDS = 8
BITS = [f"b{n}" for n in range(WORDS)]


def parity_sketches(values: np.ndarray, counts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each bag (``counts`` hashed members on end) how often each of 64 cells a word is hit, modulo two, as 64-bit words.

    Bags that differ in d members have sketches that differ in d bits at most.
    """
    cells = 64 * words
    row = np.repeat(np.arange(len(counts)), counts)
    hits = np.bincount(row * cells + (values & np.uint64(cells - 1)).astype(np.int64), minlength=len(counts) * cells)
    bits = np.packbits((hits & 1).astype(np.uint8).reshape(len(counts), cells), axis=1).view(np.int64)
    return [np.ascontiguousarray(bits[:, n]) for n in range(words)]


def bits_apart(a: str, b: str) -> tuple[Column, Column]:
    """In how many bits the first and the second half of two sketches differ; their words have these prefixes."""
    each = [F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in BITS]
    half = WORDS // 2
    return sum(each[1:half], each[0]), sum(each[half + 1 :], each[half])


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of keys that several nodes have: bucket, node, first (the smallest node with this key) and more: whether the bucket may have a third."""
    own = Window.partitionBy("key")
    named = keys.select("key", "node", F.min("node").over(own).alias("first"), F.max("node").over(own).alias("last"), F.count("*").over(own).alias("n"))
    more = (F.col("n") > 2) | (F.col("key").bitwiseAND(F.lit((1 << SALT) - 1)) != 0)
    return named.where("first < last").select(F.shiftright("key", SALT).alias("key"), "node", "first", more.alias("more"))


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets that hold nodes of several components: key, node, comp."""
    named = members.join(components.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    named, held = written(named, "members")
    several = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    mixed = staged(named.join(several, "key", "left_semi"), "mixed")
    discard(members.sparkSession, held)
    return mixed


def _leader_pairs(mixed: DataFrame, seed: int) -> DataFrame:
    leader = mixed.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(seed))).alias("lead"))
    met = mixed.join(leader, "key").where("comp <> lead.comp")
    return met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _tile_pairs(mixed: DataFrame, sketches: DataFrame, may_link: Callable, tile: int) -> DataFrame:
    """Pairs of different components that share a bucket and whose sketches let them through."""
    sizes = mixed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    placed = mixed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(sketches.select("node", "size", *BITS), "node")
    tiles = placed.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("node", "comp", "size", *BITS)).alias("nodes"))
    facing = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    facing = facing.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("nodes").alias("tiles"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch["tiles"]
            inner = tiles.flatten()
            nodes = inner.flatten()
            column = {n: nodes.field(n).to_numpy(zero_copy_only=False) for n in ("node", "comp", "size")}
            words = np.stack([nodes.field(n).to_numpy(zero_copy_only=False) for n in BITS], axis=1).view(np.uint64)
            upto = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.concatenate([[0], np.cumsum(tiles.value_lengths().to_numpy(zero_copy_only=False))])
            found = []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                right = slice(upto[b - 1], upto[b])
                for first in range(upto[a], upto[a + 1], STRIP):
                    left = slice(first, min(first + STRIP, upto[a + 1]))
                    on = column["comp"][left][:, None] != column["comp"][right][None, :]
                    if b - a == 1:
                        on = np.triu(on, 1 + left.start - right.start)
                    i, j = np.nonzero(on)
                    if not len(i):
                        continue
                    i, j = i + left.start, j + right.start
                    apart = np.bitwise_count(words[i] ^ words[j])
                    low, high = apart[:, : WORDS // 2].sum(axis=1, dtype=np.int64), apart[:, WORDS // 2 :].sum(axis=1, dtype=np.int64)
                    ok = may_link(column["size"][i], column["size"][j], low, high)
                    x, y = column["node"][i[ok]], column["node"][j[ok]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return facing.select("tiles").mapInArrow(compare, "a long, b long").distinct()


def merged_keys(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nodes so that a bucket that many nodes of a task share is not one key of many rows.

    A key's low bits are cleared, and its smallest node here has it, twice where there are
    others. All of those have it once more, with low bits that say where they met.
    """
    key = key >> np.uint64(SALT) << np.uint64(SALT)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(key)))
    shared = sizes > 1
    several = np.repeat(shared, sizes)
    lead = np.repeat(node[heads], sizes)[several]
    salt = np.uint64(1) + mix(lead.astype(np.uint64), 3) % np.uint64((1 << SALT) - 1)
    twice = heads[shared]
    return np.concatenate([key[heads], key[twice], key[several] | salt]), np.concatenate([node[heads], node[twice], node[several]])


def pair_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of its own for each pair of nodes that are known to be alike."""
    own = mix(mix(a.astype(np.uint64)) + b.astype(np.uint64), 13)
    return np.concatenate([own, own]), np.concatenate([a, b])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def cell_bitmap(nodes: DataFrame, cell: Column):
    """A broadcast bitmap of the cells of nodes, for a first look: 1 MB whatever the number of nodes."""
    at = F.pmod(cell, F.lit(CELLS)).cast("long") + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(CELLS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["n"] - 1) * 4096 : (r["n"] - 1) * 4096 + len(part)] = part
    return nodes.sparkSession.sparkContext.broadcast(out.tobytes())


def in_bitmap(bitmap: bytes, cell: np.ndarray) -> np.ndarray:
    at = cell.view(np.uint64) & np.uint64(CELLS - 1)
    return (np.frombuffer(bitmap, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bucket_links(keys: DataFrame, prepare: Callable[[DataFrame], tuple], may_link: Callable, tile: int = TILE, rounds: int = 2) -> DataFrame:
    """Components (id, component) of all nodes that links reach.

    ``keys``: key, node, as :func:`merged_keys` gives them. ``prepare`` gets the nodes that share a
    bucket with another and returns ``sketches`` (node, size and the words of a parity sketch),
    ``verify``, which keeps the linked ones of pairs (a, b), ``apart``, which leaves out rows of
    nodes that have an equal among others, and ``equals``, links (a, b) of all that it leaves out, or
    None. ``may_link(size, size, low, high)``, of the bits in
    which both halves of the sketches differ, is true wherever there is a link. ``rounds`` stars
    around a random node follow the one around the smallest.
    """
    shared = staged(shared_keys(keys), "shared")
    tested = staged(shared.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sketches, verify, apart, equals = prepare(tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct())
    links = verify(tested)
    links, held = written(links if equals is None else links.unionByName(equals), "links")
    components = connected_components(links)
    discard(keys.sparkSession, held)
    members = apart(shared.where("more").select("key", "node"))  # a bucket of two is settled by its star
    for seed in range(1, rounds + 2):
        mixed = _mixed(members, components)
        if not mixed.take(1):
            break
        pairs = _tile_pairs(mixed, sketches, may_link, tile) if seed > rounds else _leader_pairs(mixed, seed)
        pairs = staged(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more, held = written(verify(pairs), "links")
        if more.take(1):
            components = connected_components(more.unionAll(components.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        discard(keys.sparkSession, held)
        members, tested = mixed.select("key", "node"), tested.unionAll(pairs)
    return components
