"""Line dedup by a segment-partition edit join.

Two lines are linked when their edit distance is a tenth of the shorter one's length or less, and
``EDITS`` at most. A line is cut into one segment more than the edits it may have, so a line within
this distance holds one of the segments unchanged, and close to where it stood: each line probes an
index of segments by length, segment and content at the few starts that are possible. Candidates are
verified by banded bit-parallel edit distance. Of all lines that links reach, the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, text_slices, utf8
from .bpe import rest
from .buckets import BITS, TILE, WORDS, bits_apart, bucket_links, cell_bitmap, in_bitmap, merged_keys, parity_sketches, signed
from .edits import within_edits
from .hashes import RollingSums
from .storage import discard, staged, written

EDITS = 2
#: Code points of the shorter line for each edit.
SHARE = 10
SLICE = 1 << 18
#: Keys of an index that a task holds before it merges and hands them on.
HELD = 400_000

_INK = np.ones(256, bool)  # bytes that are no white space
_INK[[*range(9, 14), *range(28, 33)]] = False


def edits_of(size: np.ndarray, edits: int, share: int) -> np.ndarray:
    """Edits that lines may have whose shorter one has so many code points."""
    return np.minimum(edits, size // share)


class Lines:
    """The lines of many texts that are not blank.

    ``row`` and ``place`` say where a line stands, ``starts`` and ``ends`` its bytes, ``chars`` its code points. Its name
    is ``node``, 64 bits of a 128-bit hash of its bytes; ``check`` has the others. ``renamed`` are
    names that several lines have (ascending); theirs are made of all bits.
    """

    def __init__(self, texts: pa.Array, renamed: np.ndarray, bits: int = 64):
        self.data, bounds = utf8(texts)
        self.raw = self.data.tobytes()
        feeds = np.flatnonzero(self.data == 10)
        rows = len(bounds) - 1
        counts = np.bincount(np.searchsorted(bounds, feeds, side="right") - 1, minlength=rows) + 1
        # a line ends at its line feed or where its text ends
        order = np.argsort(np.concatenate([feeds * 2, bounds[1:] * 2 - 1]), kind="stable")
        ends = np.concatenate([feeds, bounds[1:]])[order]
        firsts = np.cumsum(counts) - counts
        starts = np.concatenate([[0], ends[:-1] + 1])
        starts[firsts] = bounds[:-1]
        self.upto = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        ink = np.concatenate([[0], np.cumsum(_INK[self.data])])
        chars = self.upto[ends] - self.upto[starts]
        on = ink[ends] > ink[starts]
        self.row = np.repeat(np.arange(rows), counts)[on]
        self.place = (np.arange(len(ends)) - np.repeat(firsts, counts))[on]
        self.starts, self.ends, self.chars = starts[on], ends[on], chars[on]
        digests = b"".join(xxhash.xxh3_128_digest(self.raw[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist()))
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        node, self.check = both[:, 0] >> np.uint64(64 - bits), both[:, 1].view(np.int64)
        while len(renamed):
            again = np.isin(node, renamed)
            if not again.any():
                break
            node = np.where(again, mix(node ^ both[:, 1]), node)
        self.node = node.view(np.int64)

    def distinct(self, chosen: np.ndarray) -> np.ndarray:
        """Numbers of the chosen lines, one for each name."""
        at = np.flatnonzero(chosen)
        return at[np.unique(self.node[at], return_index=True)[1]]


def segment_keys(sums: RollingSums, starts: np.ndarray, ends: np.ndarray, edits: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Line number and key of every segment in the index, and of every probe of it by lines that are as long or longer."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    size = ends - starts
    for own in range(1, edits + 1):
        for longer in range(own + 1):
            every = np.flatnonzero(edits_of(size - longer, edits, share) == own)
            length = size[every] - longer
            for k in range(own + 1):
                # the last segments take what does not divide evenly
                even = own + 1 - length % (own + 1)
                wide = length // (own + 1) + (k >= even)
                at = k * (length // (own + 1)) + np.maximum(0, k - even)
                # the part before the segment differs by k edits at most, the part behind it by the others
                low, high = max(-k, longer - (own - k)), min(k, longer + (own - k))
                for shift in range(low, high + 1):
                    begin = at + shift
                    on = (begin >= 0) & (begin + wide <= size[every])
                    salt = mix((length[on] * (edits + 1) + k).astype(np.uint64), 17)
                    first = starts[every[on]] + begin[on]
                    rows.append(every[on])
                    keys.append(mix(sums.runs(first, first + wide[on]) + salt))
    return np.concatenate(rows), np.concatenate(keys)


def line_components(rows: DataFrame, firsts: DataFrame, renamed: np.ndarray, edits: int = EDITS, share: int = SHARE, tile: int = TILE, bits: int = 64) -> DataFrame:
    """``id`` and ``component`` of the names of lines that links reach, but for each component's smallest.

    ``rows``: text_hash and text; ``firsts``: node and first, which has the text_hash of a text that holds the line.
    """
    texts = rows.select("text_hash", "text")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        held, count = [], 0

        def merged():
            key, node = merged_keys(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([signed(key), pa.array(node)], names=["key", "node"])

        for batch in text_slices(batches, "text", SLICE):
            lines = Lines(batch["text"], renamed, bits)
            own = lines.distinct(lines.chars >= share)
            sums = RollingSums(np.frombuffer(lines.raw.decode().encode("utf-32-le"), np.uint32))
            row, key = segment_keys(sums, lines.upto[lines.starts[own]], lines.upto[lines.ends[own]], edits, share)
            held.append((key, lines.node[own][row]))
            count += len(key)
            if count >= HELD:
                yield merged()
                count = 0
        if held:
            yield merged()

    def prepare(nodes: DataFrame):
        nodes = staged(nodes, "nodes")
        cells = cell_bitmap(nodes, F.col("node"))
        places = nodes.join(firsts, "node").select("first.text_hash").distinct()
        spots = cell_bitmap(places, F.col("text_hash"))

        def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = (b.filter(pa.array(in_bitmap(spots.value, b["text_hash"].to_numpy(zero_copy_only=False)))) for b in batches)
            for batch in text_slices(some, "text", SLICE):
                lines = Lines(batch["text"], renamed, bits)
                own = lines.distinct((lines.chars >= share) & in_bitmap(cells.value, lines.node))
                sizes = lines.chars[own]
                parts = [lines.raw[a:b] for a, b in zip(lines.starts[own].tolist(), lines.ends[own].tolist())]
                codes = np.frombuffer(b"".join(parts).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
                # an edit changes the counts of two code points at most, and of four pairs of neighbours
                pairs = mix(codes[:-1] * np.uint64(0x110000) + codes[1:], 19) if len(codes) else codes
                inner = np.ones(len(codes), bool)
                inner[np.cumsum(sizes) - 1] = False
                words = [*parity_sketches(mix(codes, 23), sizes, WORDS // 2), *parity_sketches(pairs[inner[:-1]], sizes - 1, WORDS // 2)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.node[own]), pa.array(sizes), *map(pa.array, words), pa.array(parts, pa.binary())], names=["node", "size", *BITS, "line"])

        found = texts.mapInArrow(chosen, "node long, size long, " + ", ".join(f"{b} long" for b in BITS) + ", line binary")
        lines = staged(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "lines")
        cells.destroy()
        spots.destroy()

        def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = ([np.frombuffer(str(x.as_buffer(), "utf-8").encode("utf-32-le"), np.uint32) for x in batch[c]] for c in ("x", "y"))
                may = edits_of(np.array([min(len(x), len(y)) for x, y in zip(one, two)], np.int64), edits, share)
                near = np.zeros(len(one), bool)
                for own in range(1, edits + 1):
                    at = np.flatnonzero(may == own)
                    near[at] = within_edits([one[n] for n in at], [two[n] for n in at], own)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near))

        def verify(pairs: DataFrame) -> DataFrame:
            side = lambda c: lines.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", *BITS)))
            met = pairs.join(side("a"), "a").join(side("b"), "b")
            low, high = bits_apart("a_", "b_")
            own = F.least(F.lit(edits), F.floor(F.least("a_size", "b_size") / share))
            looked = staged(met.where((F.abs(F.col("a_size") - F.col("b_size")) <= own) & (low <= 2 * own) & (high <= 4 * own)).select("a", "b"), "looked")
            both = looked.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
            return both.mapInArrow(close, "a long, b long")

        return lines, verify, lambda members: members, None

    def may_link(m: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        own = edits_of(np.minimum(m, n), edits, share)
        return (np.abs(m - n) <= own) & (low <= 2 * own) & (high <= 4 * own)

    return bucket_links(texts.mapInArrow(emit, "key long, node long"), prepare, may_link, tile, rounds=1)


def _named_lines(rows: DataFrame, kind: str, bits: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Places of all lines (id, text_hash, place, node), what each name has (node, first, last place), and the names that had to be made anew.

    Two lines that share 64 bits of their hashes show by the others, and are given other names before anything is
    decided; some n² / 2⁶⁵ of n lines do, so their names are a bounded broadcast.
    """
    renamed = np.zeros(0, np.uint64)
    while True:

        def places(batches: Iterable[pa.RecordBatch], renamed=renamed) -> Iterator[pa.RecordBatch]:
            rest()
            for batch in text_slices(batches, "text", SLICE):
                lines = Lines(batch["text"], renamed, bits)
                at = pa.array(lines.row)
                columns = [batch["id"].take(at), batch["text_hash"].take(at), pa.array(lines.place), pa.array(lines.node), pa.array(lines.check)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "place", "node", "check"])

        seen, held = written(rows.mapInArrow(places, f"id {kind}, text_hash long, place long, node long, check long"), "line-places")
        at = F.struct("id", "text_hash", "place")
        each, known = written(seen.groupBy("node").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("check").alias("low"), F.max("check").alias("high")), "line-firsts")
        shared = [r[0] for r in each.where("low <> high").select("node").collect()]
        if not shared:
            return seen.drop("check"), each.drop("low", "high"), renamed
        discard(rows.sparkSession, held, known)
        renamed = np.union1d(renamed, np.array(shared, np.int64).view(np.uint64))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: int = SHARE, tile: int = TILE, bits: int = 64) -> DataFrame:
    """``id_col``, text_hash and removed (line numbers from 0, ascending) of every text that holds lines met before.

    "Before" is by (id, text_hash, line number), null ids first. Two lines link within one edit for every ``share`` code
    points of the shorter one, and within ``edits`` at most; so lines of fewer than ``share`` link where they are equal. Blank lines,
    of ASCII white space alone, are no lines to remove. Rows of one id and text are one document. ``bits`` of a line's
    hash name it at first, fewer only in tests.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    seen, each, renamed = _named_lines(rows, kind, bits)
    at = F.struct("id", "text_hash", "place")
    linked = line_components(rows, each, renamed, edits, share, tile, bits)
    several = staged(linked.select(F.col("id").alias("node"), "component").union(linked.select("component", "component").distinct()), "line-groups")
    firsts = several.join(each, "node").groupBy("component").agg(F.min("first").alias("keep"))
    kept = several.join(firsts, "component").select("node", "keep")
    known = each.join(kept, "node", "left").select("node", F.coalesce("keep", "first").alias("keep"), "first", "last")
    known = staged(known.where("first <> last or keep <> first").select("node", "keep"), "line-keeps")
    gone = seen.join(known, "node").where(~at.eqNullSafe(F.col("keep")))
    return gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("removed")).withColumnRenamed("id", id_col)


def count_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: int = SHARE, tile: int = TILE, bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_lines, n_kept and removed, the numbers of lines that were met before.

    A null or empty text is one empty line. Rows of one id and text are one document. An empty
    table gives no rows. Other columns are not read.
    """
    gone = repeated_lines(docs, id_col, text_col, edits, share, tile, bits)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), lines.alias("n_lines"))
    met = rows.join(gone, rows["id"].eqNullSafe(gone[id_col]) & (rows["hash"] == gone["text_hash"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<long>"))
    return met.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: int = SHARE, tile: int = TILE) -> DataFrame:
    """``docs`` without lines that were met before; a text of which nothing but white space is left goes, if it lost a line.

    All columns stay; rows without such lines stay as they are, null texts included. Rows of one id and text are one document and lose the same lines.
    """
    gone = repeated_lines(docs, id_col, text_col, edits, share, tile).select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed"))
    met = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left")

    names = docs.columns

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, removed in zip(batch[text_col].to_pylist(), batch["__removed"].to_pylist()):
                if removed:
                    drop = set(removed)
                    text = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in drop)
                texts.append(text)
            lost = batch["__removed"].is_valid().to_pylist()
            on = [not (a and not b.strip()) for a, b in zip(lost, texts)]
            columns = [pa.array(texts, pa.string()) if c == text_col else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(on, pa.bool_()))

    return met.select(*names, "__removed").mapInArrow(cut, docs.schema)
