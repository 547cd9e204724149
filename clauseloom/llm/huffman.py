"""Token ids in canonical length-limited Huffman code.

A file set is a folder with two Parquet tables: ``codebook`` (one row: the code length of
every id) and ``blocks`` (independent blocks of whole documents in ascending order). A
block's payload is the bit string of its ids; ``checkpoints`` has the bit offset of every
``interval``-th id, so that a reader starts at any of them and decodes them side by side
by one table look-up per id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .batches import text_slices
from .bpe import encoder
from .storage import staged

#: Ids after which a block is closed, at the next document's end.
BLOCK_IDS = 1 << 16
#: Ids between two checkpoints.
INTERVAL = 128
#: Bits of the longest code, unless the vocabulary needs more.
MAX_BITS = 16


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("max_bits is too small for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaves))
        merged = weights[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        before = n
        own = np.flatnonzero(lengths == n)
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each string of ``bits`` bits the id it starts with and its code's length, as id * 32 + length."""
    width = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (width - lengths[order].astype(np.int64))
    table = np.zeros(1 << width, np.int64)
    table[: spans.sum()] = np.repeat(order * 32 + lengths[order], spans)
    return table, width


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes and checkpoints."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return bits.pack(codes[ids], sizes, starts, int(ends[-1]) if len(ends) else 0), starts[::interval].astype(np.int64)


def decode_ids(payload: np.ndarray, checkpoints: np.ndarray, n: int, interval: int, table: np.ndarray, width: int) -> np.ndarray:
    """The ``n`` ids of a block, all its checkpoints followed at once."""
    window = bits.windows(payload)
    last = 8 * len(payload)
    at = checkpoints.astype(np.int64)
    out = np.empty((interval, len(at)), np.int32)
    for step in range(min(interval, n)):
        entry = table[bits.peek(window, np.minimum(at, last), width)]
        out[step] = entry >> 5
        at = at + (entry & 31)
    return out.T.ravel()[:n]


def tokenized_blocks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, block_ids: int) -> DataFrame:
    """Blocks of plain ids in ascending order: part, block, before (ids of the part before it), n_ids, keys, counts, ids. ``part`` ascends with the ids of documents."""
    key = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        kind = "<u2" if bpe.vocabulary <= 1 << 16 else "<u4"
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "before": [before], "n_ids": [len(ids)], "keys": [keys], "counts": [counts], "ids": [ids.astype(kind).tobytes()], "wide": [kind == "<u4"]}, schema=schema)

        for batch in text_slices(batches, "text"):
            schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(batch.schema.field("key").type)), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("wide", pa.bool_())])
            flat, bounds = bpe.encode(batch["text"], end_id)
            size = sum(counts)
            for k, a, b in zip(batch["key"].to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                keys.append(k)
                counts.append(b - a)
                held.append(flat[a:b])
                size += b - a
                if size >= block_ids:
                    yield close()
                    keys, counts, held, before, size, block = [], [], [], before + size, 0, block + 1
        if keys:
            yield close()

    ordered = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    return ordered.mapInArrow(blocks, f"part int, block int, before long, n_ids long, keys array<{key}>, counts array<long>, ids binary, wide boolean")


def global_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs; each task sends a count for each id at most, and the driver gets one for each id."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, wide in zip(batch["ids"], batch["wide"].to_pylist()):
                own = np.bincount(np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2"))
                total = np.concatenate([total, np.zeros(max(0, len(own) - len(total)), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    rows = blocks.select("ids", "wide").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_huffman(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS, interval: int = INTERVAL, max_bits: int = MAX_BITS
) -> None:
    """Encode every text, with ``end_id`` after it, and write the ids to the folder ``path`` in ascending ``id_col`` order.

    Texts are sorted by range, tokenised once into a shared intermediate table, counted and
    encoded block by block; no task holds more than a block and its longest document.

    A null or empty text is ``end_id`` alone. Null ids come first; rows of one id follow each
    other by text. An empty table gives an empty file set. Other columns are not read.
    """
    spark = docs.sparkSession
    blocks = staged(tokenized_blocks(docs, tokenizer, id_col, text_col, end_id, block_ids), "ids")
    counts = global_counts(blocks)
    lengths = code_lengths(counts, max(max_bits, (len(counts) - 1).bit_length()))
    codes = canonical_codes(lengths)
    shipped = spark.sparkContext.broadcast((lengths, codes))  # one entry for each id of the vocabulary

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lengths, own_codes = shipped.value
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                payload, checkpoints = encode_ids(np.frombuffer(row["ids"][0].as_buffer(), "<u4" if row["wide"][0].as_py() else "<u2"), own_lengths, own_codes, interval)
                yield pa.RecordBatch.from_arrays(
                    [row["part"], row["block"], row["before"], row["n_ids"], row["keys"], row["counts"], pa.array([interval], pa.int32()), pa.array([checkpoints.tolist()], pa.list_(pa.int64())), pa.array([payload.tobytes()], pa.binary())],
                    names=["part", "block", "before", "n_ids", "keys", "counts", "interval", "checkpoints", "payload"],
                )

    plain = blocks.schema
    kinds = f"part int, block int, before long, n_ids long, keys {plain['keys'].dataType.simpleString()}, counts array<long>, interval int, checkpoints array<long>, payload binary"
    blocks.mapInArrow(encode, kinds).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def read_huffman(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of a file set: ``id_col``, start (ids of all documents before), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit, unless left out)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each writing task
        base[r["part"]], total = total, total + r["n"]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                payload = np.frombuffer(row["payload"][0].as_buffer(), np.uint8)
                checkpoints = row["checkpoints"].flatten().to_numpy(zero_copy_only=False)
                ids = decode_ids(payload, checkpoints, row["n_ids"][0].as_py(), row["interval"][0].as_py(), table, width).astype("<u4")
                counts = row["counts"].flatten().to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(counts)])
                view = memoryview(ids).cast("B")
                parts = [view[4 * a : 4 * b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
                first = base[row["part"][0].as_py()] + row["before"][0].as_py()
                columns = [row["keys"].flatten(), pa.array(first + edges[:-1]), pa.array(counts), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    key = blocks.schema["keys"].dataType.elementType.simpleString()
    return blocks.mapInArrow(decode, f"key {key}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("key", id_col)
