"""Byte-level BPE ids by the ``tokenizers`` library, each distinct piece of text once."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import gather, utf8
from .hashes import distinct, piece_hashes

#: Distinct pieces, and ids of theirs, that a worker keeps before it starts over.
CACHE_PIECES, CACHE_IDS = 1_400_000, 6_000_000
#: Bytes of new pieces that go through the library on end.
JOIN = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _unsplit(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows hold adjoining ASCII white space, or white space beyond ASCII: a cut at spaces could change their ids."""
    space = _SPACE[data]
    at = [np.flatnonzero(space[1:] & space[:-1])]
    high = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(high):
        one, two = (np.concatenate([data, np.zeros(2, np.uint8)])[high + k] for k in (1, 2))
        lead = data[high]
        wide = (lead == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (lead == 0xE1) & (one == 0x9A) & (two == 0x80) | (lead == 0xE3) & (one == 0x80) & (two == 0x80)
        wide |= (lead == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))
        at.append(high[wide])
    rows = np.searchsorted(bounds, np.concatenate(at), side="right") - 1
    out = np.zeros(len(bounds) - 1, bool)
    out[rows] = True
    return out


class BpeEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A byte-level pre-tokenizer always starts a new token at a lone space, and at both sides of a
    lone line end, so a text can be cut there and every distinct piece encoded once. Pieces are
    known by 128-bit hashes; should two agree in the half that they are sorted by, hashing starts
    anew with another seed. New ones go through the library on end; as each id
    stands for known bytes, the pieces' sizes say where one ends. Texts with other white space
    are one piece, and so are those that hold the text of an added token, which the library
    gives that token's id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size()
        # a byte-level vocabulary writes each byte as one character
        self._bytes = np.array([len(self._tokenizer.id_to_token(n) or "") for n in range(self.vocabulary)], np.int64)
        added = {n: t.content for n, t in self._tokenizer.get_added_tokens_decoder().items()}
        for n, content in added.items():
            self._bytes[n] = len(content.encode())
        self._added = [content for content in added.values() if content]
        self._seed = 0
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(0, np.uint64)  # sorted, and in the same order:
        self._check = np.zeros(0, np.uint64)
        self._starts = np.zeros(0, np.int32)
        self._lengths = np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.int32)

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces on end, in the order given, and how many each has."""
        sizes = ends - starts
        last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
        joins = ~whole & (sizes > 1)
        joins[joins] = data[starts[joins]] == 32
        joins &= ~_SPACE[last]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        flat = gather(data, starts[order], sizes[order]).tobytes()
        reach = np.cumsum(sizes[order])
        own = int(joins.sum())
        cuts = np.flatnonzero(np.diff(reach[:own] // JOIN, append=-1)) + 1 if own else []
        edges = [0, *reach[np.asarray(cuts, np.int64) - 1].tolist(), *reach[own:].tolist()]
        texts = [flat[a:b].decode() for a, b in zip(edges, edges[1:])]
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))
        stop = np.searchsorted(np.cumsum(self._bytes[ids]), reach, side="right")
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        counts = np.empty(len(order), np.int64)
        counts[order] = stop - begin
        first = np.empty(len(order), np.int64)
        first[order] = begin
        return gather(ids, first, counts), counts

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct piece each piece is, and where the table of known pieces has the distinct ones; new ones join it."""
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
            return self._places(data, starts, ends, whole)
        new = np.flatnonzero(~known)
        if len(new):
            pick = first[new]
            ids, counts = self._encode_new(data, starts[pick], ends[pick], whole[pick])
            begin = len(self._ids) + np.cumsum(counts) - counts
            place = at[new]
            self._hash = np.insert(self._hash, place, own[new])
            self._check = np.insert(self._check, place, check[new])
            self._starts = np.insert(self._starts, place, begin)
            self._lengths = np.insert(self._lengths, place, counts)
            self._ids = np.concatenate([self._ids, ids])
            at = np.searchsorted(self._hash, own)
        return code, at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end (int32), with ``end_id`` after each, and the bounds of each text's ids. Null texts are empty."""
        data, bounds = utf8(texts)
        if len(self._hash) > CACHE_PIECES or len(self._ids) > CACHE_IDS:
            self._forget()
        uncut = _unsplit(data, bounds)
        for content in self._added:
            uncut |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        line = np.flatnonzero(data == 10)
        cuts = np.concatenate([np.flatnonzero(data == 32), line, line + 1])
        cuts = cuts[cuts < len(data)]
        cuts = cuts[~uncut[np.searchsorted(bounds, cuts, side="right") - 1]]
        starting = np.zeros(len(data) + 1, bool)
        starting[cuts] = True
        starting[bounds[:-1]] = True
        starts = np.flatnonzero(starting[:-1])
        ends = np.append(starts[1:], bounds[-1]) if len(starts) else starts
        row = np.searchsorted(bounds, starts, side="right") - 1
        code, at = self._places(data, starts, ends, uncut[row])
        lengths = self._lengths[at][code].astype(np.int64)
        flat = gather(self._ids, self._starts[at][code].astype(np.int64), lengths)
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, bounds)]
        if end_id is None:
            return flat, upto
        return np.insert(flat, upto[1:], end_id), upto + np.arange(len(upto))


_KEPT: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder for all tasks of a worker process."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = BpeEncoder(path)
    return _KEPT[path]


def rest() -> None:
    """Drop the encoder that a worker keeps; tasks of other operators begin with this."""
    _KEPT.clear()
