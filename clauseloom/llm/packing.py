"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two, the longest first:
as many of ``max_tokens`` as fit, then the binary digits of what is left. A piece is a
sequence of its own, so no sequence crosses documents and none needs padding, and
sequences of one length form a bucket that batches draw from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import binary_rows, runs, text_slices
from .bpe import encoder


def decompose(counts: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and length of every piece of rows with ``counts`` ids."""
    steps = max_tokens.bit_length() - 1
    whole = counts >> steps
    digits = (counts[:, None] >> np.arange(steps - 1, -1, -1)) & 1
    pieces = whole + digits.sum(axis=1)
    row = np.repeat(np.arange(len(counts)), pieces)
    nth = runs(pieces)
    length = np.full(len(row), max_tokens, np.int64)
    at, digit = np.nonzero(digits)
    length[nth >= whole[row]] = 1 << (steps - 1 - digit)
    before = np.concatenate([[0], np.cumsum(length)])[:-1]
    return row, before - (np.cumsum(counts) - counts)[row], length


def pack_power_of_two(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """Pieces of every row of ``docs``: ``id_col``, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, ids.

    ``tokenizer`` is a file of a byte-level BPE for the ``tokenizers`` library. ``bucket`` is the
    length's exponent. A sequence holds one piece at offset 0; ``sequence_id`` is distinct over
    the result and ascends with the bucket. ``ids`` are little-endian unsigned 32-bit numbers,
    left out without ``with_ids``. Nothing is shuffled, and each task streams its rows.

    A null or empty text is a document of ``end_id`` alone. Repeated rows, and null or repeated
    ids, are documents of their own. An empty table gives no pieces. Other columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    key = docs.schema[id_col]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in text_slices(batches, "text"):
            flat, bounds = bpe.encode(batch["text"], end_id)
            ids = flat.astype("<u4")
            counts = np.diff(bounds)
            row, start, length = decompose(counts, max_tokens)
            edges = np.concatenate([[0], np.cumsum(length)])
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            columns = [batch["key"].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])]
            if with_ids:
                columns.append(binary_rows(ids, edges))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    found = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        pieces, f"key {key.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    )
    bucket = F.round(F.log2("length")).cast("int")
    return found.select(
        F.col("key").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", bucket.alias("bucket"),
        (F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[5:],
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences so that each bucket of equal lengths is a folder of its own."""
    pieces.write.partitionBy("bucket").parquet(path)


def unpack(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ids of each document, its pieces put together again. Ids of documents must be distinct.

    One document's pieces meet in a row, as they did before they were cut.
    """
    parts: Column = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return pieces.groupBy(id_col).agg(joined.alias("ids"))
