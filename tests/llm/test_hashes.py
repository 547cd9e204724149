"""Pieces are told apart whatever their text: words that defeat sums of powers among them, in every operator that hashes."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from clauseloom.llm.bpe import BpeEncoder
from clauseloom.llm.hashes import LANES, piece_hashes
from clauseloom.llm.huffman import read_huffman, write_huffman
from clauseloom.llm.lattice import decode_pieces, sample_pieces
from clauseloom.llm.lines import count_repeated_lines
from clauseloom.llm.packing import pack_power_of_two, unpack
from clauseloom.llm.partenum import jaccard_groups
from clauseloom.llm.quality import line_features
from clauseloom.llm.storage import scratch_path

from .cases import frame

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(a, b, size=2048):
    return "".join((a, b)[bin(n).count("1") % 2] for n in range(size))


TEXTS = [thue_morse("a", "b"), thue_morse("b", "a"), thue_morse("x", "é"), thue_morse("é", "x"), thue_morse("ab ", "ba "), thue_morse("ba ", "ab ")]


def test_like_pieces_have_like_hashes_and_others_not():
    rng = np.random.default_rng(0)
    pieces = [b"", *(bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in [*range(1, 20)] * 20 + [8 * LANES - 1, 8 * LANES, 8 * LANES + 1, 500])]
    pieces += [t.encode() for t in TEXTS] + pieces
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    for seed in (0, 3):
        one, two = piece_hashes(data, starts, ends, seed)
        for h in (one, two):
            names = {}
            assert all(names.setdefault(p, x) == x for p, x in zip(pieces, h.tolist())) and len(set(names.values())) == len(names)


def test_ids_of_texts_that_sums_of_powers_confuse(spark):
    library = Tokenizer.from_file(BPE)
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in TEXTS]
    made = frame(spark, list(enumerate(TEXTS)))
    assert {r.doc_id: bytes(r.ids) for r in unpack(pack_power_of_two(made, BPE)).collect()} == dict(enumerate(want))
    path = scratch_path(spark, "test-huffman")
    write_huffman(made, path, BPE)
    assert {r.doc_id: r.ids_crc32 for r in read_huffman(spark, path).collect()} == {n: zlib.crc32(w) for n, w in enumerate(want)}
    assert {r.doc_id: r.text for r in decode_pieces(sample_pieces(made, PIECES), PIECES).collect()} == dict(enumerate(TEXTS))


def test_groups_and_lines_of_such_texts(spark):
    made = frame(spark, list(enumerate(TEXTS)))
    assert {r.doc_id: r.component_id for r in jaccard_groups(made).collect() if r.doc_id < 4} == {n: n for n in range(4)}
    assert all(not r.removed for r in count_repeated_lines(made).collect())
    values, _, _ = line_features(pa.array([f"{TEXTS[0]}\n{TEXTS[1]}\n{TEXTS[0]}", f"{TEXTS[0]} {TEXTS[1]}"]))
    assert values[:, 10].tolist() == [0, 0, 1, 0] and values[3, 9] == 0


def test_an_encoder_starts_anew_when_hashes_agree(monkeypatch):
    from clauseloom.llm import bpe

    def weak(data, starts, ends, seed=0):
        one, two = piece_hashes(data, starts, ends, seed)
        return (one & np.uint64(3) if seed < 2 else one), two

    monkeypatch.setattr(bpe, "piece_hashes", weak)
    encoder, library = BpeEncoder(BPE), Tokenizer.from_file(BPE)
    for text in ("one", "two words", "some words more than one and two", "one two"):
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
