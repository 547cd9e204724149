"""SentencePiece segmentations sampled from the lattice of pieces, and lossless decoding.

Every way to write a text as pieces of the model has a probability, the product of its pieces' weights.
Forward filtering sums, for each position, the weights of all ways to get there; backward
sampling starts at the end and draws the last piece by these sums, then the one before it. No
piece spans from a character to the space or line end behind it, so words are filtered once,
however often they occur, while each occurrence draws pieces of its own. The draws are a
function of the row's key, the place in the text and the seed, and so of nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import binary_rows, gather, mix, text_slices, utf8
from .hashes import distinct, piece_hashes

SLICE = 1 << 20
#: Edges of words' lattices that a worker keeps before it starts over.
CACHE_EDGES = 6_000_000
#: How much less likely a byte is than the rarest piece, in nats.
BYTE_PENALTY = 5.0


class PieceLattice:
    """Samples segmentations with the pieces of a SentencePiece model.

    Weights are the scores of a unigram model. A BPE model has ranks only; its pieces weigh as by
    Zipf's law, one over the rank. ``alpha`` is the power that weights are raised to. A
    character that is no piece is written as its bytes.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [n for n in range(model.vocab_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n))]
        plain = [n for n in ids if not model.is_byte(n)]
        scores = np.array([model.get_score(n) for n in plain])
        if scores.size and (scores == np.floor(scores)).all():  # ranks
            scores[np.argsort(-scores, kind="stable")] = -np.log(np.arange(len(scores)) + 2.0)
        self.bytes: list[bytes] = [b""] * model.vocab_size()
        self._weight = np.full(model.vocab_size(), -np.inf)
        self._byte = np.full(256, -1, np.int64)
        for n, s in zip(plain, scores.tolist()):
            self.bytes[n] = model.id_to_piece(n).replace("▁", " ").encode()
            self._weight[n] = alpha * s
        least = self._weight[plain].min(initial=0.0)
        for n in ids:
            if model.is_byte(n):
                value = int(model.id_to_piece(n)[3:5], 16)
                self.bytes[n], self._byte[value], self._weight[n] = bytes([value]), n, least - alpha * BYTE_PENALTY
        inner = [self.bytes[n] for n in plain]
        self._at_spaces = not any(b" " in p.lstrip(b" ") for p in inner)
        self._at_lines = not any(b"\n" in p for p in inner)
        self._trie, self._final = _trie([(self.bytes[n], n) for n in plain])
        self._sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._seed = 0
        self._forget()

    def _forget(self) -> None:
        self._hash, self._check, self._last = (np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64))
        self._keys, self._piece, self._from = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self._nodes = 0

    def _edges(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge of words on end. A word of n bytes has n + 1 positions; they are numbered through."""
        position = np.arange(len(data)) + np.repeat(np.arange(len(starts)), sizes)
        stop = np.repeat(starts + sizes, sizes)
        found = []
        at, state = np.arange(len(data)), np.zeros(len(data), np.int64)
        width = 0
        single = np.zeros(len(data), bool)
        lead = (data & 0xC0) != 0x80
        length = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        while len(at):
            state = self._trie[state, data[at + width]]
            width += 1
            alive = state >= 0
            at, state = at[alive], state[alive]
            piece = self._final[state]
            hit = piece >= 0
            found.append((position[at[hit]], position[at[hit]] + width, piece[hit]))
            whole = at[hit]
            single[whole[length[whole] == width]] = True
            on = at + width < stop[at]
            at, state = at[on], state[on]
        # bytes of characters that are no piece
        lone = np.flatnonzero(lead & ~single)
        lone = gather(np.arange(len(data)), lone, length[lone])
        found.append((position[lone], position[lone] + 1, self._byte[data[lone]]))
        if (found[-1][2] < 0).any():
            raise ValueError("a character is neither a piece nor written in bytes by this model")
        return tuple(np.concatenate(c) for c in zip(*found))

    def _filter(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Forward filtering of new words; their edges join the table that draws look into."""
        begin, end, piece = self._edges(data, starts, sizes)
        first = starts + np.arange(len(starts))
        place = np.arange(len(data) + len(starts)) - np.repeat(first, sizes + 1)
        total = np.full(len(place), -np.inf)
        total[first] = 0
        order = np.argsort(place[end] << 40 | end, kind="stable")  # those of one end stay in order of their width
        begin, end, piece = begin[order], end[order], piece[order]
        value = self._weight[piece]
        cuts = np.flatnonzero(np.diff(place[end], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(end)]):
            value[a:b] += total[begin[a:b]]
            groups = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            total[end[a:b][groups]] = np.logaddexp.reduceat(value[a:b], groups)
        order = np.argsort(end, kind="stable")
        begin, end, piece, value = begin[order], end[order], piece[order], value[order]
        share = np.exp(value - total[end])
        before = np.cumsum(share) - share
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        widths = np.diff(np.append(heads, len(end)))
        before = np.clip(before - np.repeat(before[heads], widths), 0, 1)
        before[heads] = 0
        low = np.minimum((before * 2.0**32).astype(np.uint64), np.uint64(0xFFFFFFFF))
        self._keys = np.concatenate([self._keys, (end + self._nodes).astype(np.uint64) << np.uint64(32) | low])
        self._piece = np.concatenate([self._piece, piece.astype(np.int32)])
        self._from = np.concatenate([self._from, np.where(place[begin] == 0, -1, begin + self._nodes)])
        self._ends = first + sizes + self._nodes
        self._nodes += len(place)

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct word each word is, and where the table of known words has the distinct ones; new ones join it.

        Words are known by 128-bit hashes; should two agree in the half that they are sorted by, hashing starts anew with another seed.
        """
        one, two = piece_hashes(data, starts, ends, self._seed)
        code, first, collide = distinct(one, two)
        own, check = one[first], two[first]
        at = np.searchsorted(self._hash, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self._hash)
        known[inside] = self._hash[at[inside]] == own[inside]
        if collide or (self._check[at[known]] != check[known]).any():
            self._seed += 1
            self._forget()
            return self._places(data, starts, ends)
        new = np.flatnonzero(~known)
        if len(new):
            pick = first[new]
            sizes = ends[pick] - starts[pick]
            self._filter(gather(data, starts[pick], sizes), np.cumsum(sizes) - sizes, sizes)
            self._hash = np.insert(self._hash, at[new], own[new])
            self._check = np.insert(self._check, at[new], check[new])
            self._last = np.insert(self._last, at[new], self._ends)
            at = np.searchsorted(self._hash, own)
        return code, at

    def sample(self, texts: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (int32) and the bounds of each text's ids. A space goes before each text that is not empty."""
        raw, bounds = utf8(texts)
        if len(self._keys) > CACHE_EDGES:
            self._forget()
        full = np.flatnonzero(np.diff(bounds))
        data = np.insert(raw, bounds[full], 32)
        bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        cutting = np.zeros(len(data) + 1, bool)
        cutting[bounds[:-1]] = True
        space, line = data == 32, data == 10
        if self._at_spaces:
            cutting[np.flatnonzero(space[1:] & ~space[:-1]) + 1] = True
        if self._at_lines:
            cutting[np.flatnonzero(line)] = True
            cutting[np.flatnonzero(line) + 1] = True
        starts = np.flatnonzero(cutting[: len(data)])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        row = np.searchsorted(bounds, starts, side="right") - 1
        code, at = self._places(data, starts, ends)
        node = self._last[at][code]
        # backward sampling, all occurrences side by side
        seed = mix(seeds.view(np.uint64)[row] + mix((starts - bounds[row]).astype(np.uint64)))
        who, drawn = np.argsort(node, kind="stable"), []  # words that are alike go together, as look-ups then meet the same edges
        node = node[who]
        counts = np.zeros(len(starts), np.int64)
        step = 0
        while len(who):
            draw = mix(seed[who], step) >> np.uint64(32)
            edge = np.searchsorted(self._keys, node.astype(np.uint64) << np.uint64(32) | draw, side="right") - 1
            drawn.append((who, self._piece[edge]))
            counts[who] += 1
            node = self._from[edge]
            on = node >= 0
            who, node = who[on], node[on]
            step += 1
        reach = np.cumsum(counts)
        out = np.empty(reach[-1] if len(reach) else 0, np.int32)
        for n, (own, piece) in enumerate(drawn):
            out[reach[own] - 1 - n] = piece
        return out, np.concatenate([[0], reach])[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts on end and their bounds; the space before each text goes."""
        sizes = self._sizes[ids]
        data = gather(self._flat, self._starts[ids], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        full = np.flatnonzero(np.diff(upto))
        keep = np.ones(len(data), bool)
        keep[upto[full]] = data[upto[full]] != 32
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[upto]


def _trie(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Next state by state and byte (-1: none), and the piece that ends in each state (-1: none)."""
    children: list[dict[int, int]] = [{}]
    final = [-1]
    for raw, n in pieces:
        state = 0
        for b in raw:
            if b not in children[state]:
                children[state][b] = len(children)
                children.append({})
                final.append(-1)
            state = children[state][b]
        final[state] = n
    table = np.full((len(children), 256), -1, np.int32)
    for state, own in enumerate(children):
        table[state, list(own)] = list(own.values())
    return table, np.array(final, np.int64)


@lru_cache(maxsize=1)
def lattice(path: str, alpha: float) -> PieceLattice:
    """One lattice for all tasks of a worker process."""
    return PieceLattice(path, alpha)


def sample_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """``id_col``, n_pieces, ids_crc32, text_crc32 (of the decoded text) and ids (little-endian unsigned 32-bit, unless left out) of every row.

    ``model`` is a SentencePiece model file. A row's segmentation depends on its id, text and ``seed``
    alone. Each is decoded again, and an error is raised unless the text comes back. Nothing is
    shuffled; each task streams its rows.

    A null or empty text has no pieces. Rows of one id and text are sampled alike; a null id is a
    key of its own. Any character is written, the space mark itself in bytes. An empty table
    gives no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model, alpha)
        for batch in text_slices(batches, "text", SLICE):
            ids, bounds = pieces.sample(batch["text"], batch["seed"].to_numpy(zero_copy_only=False))
            back, ends = pieces.decode(ids, bounds)
            raw, upto = utf8(batch["text"])
            if not (np.array_equal(raw, back) and np.array_equal(upto, ends)):
                raise RuntimeError("a text does not come back from its pieces")
            plain = ids.astype("<u4")
            crc = lambda x, at, width: pa.array([zlib.crc32(memoryview(x).cast("B")[width * a : width * b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.int64())
            columns = [batch["id"], pa.array(np.diff(bounds)), crc(plain, bounds, 4), crc(back, ends, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *[binary_rows(plain, bounds)] * with_ids], names=names)

    names = ["id", "n_pieces", "ids_crc32", "text_crc32", *["ids"] * with_ids]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("seed"))
    return rows.mapInArrow(encode, f"id {kind}, n_pieces long, ids_crc32 long, text_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text of every row of :func:`sample_pieces`; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model, 1.0)
        for batch in text_slices(batches, "ids", SLICE):
            parts = [np.frombuffer(x.as_buffer(), "<u4") for x in batch["ids"]]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            data, ends = pieces.decode(np.concatenate(parts).astype(np.int64), bounds)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([raw[a:b].decode() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
