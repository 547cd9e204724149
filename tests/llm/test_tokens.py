"""Packing, Huffman files and sampled pieces against the libraries themselves."""

import math
import zlib
from collections import Counter

import numpy as np
import sentencepiece
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clauseloom.llm import huffman
from clauseloom.llm.bpe import BpeEncoder
from clauseloom.llm.lattice import PieceLattice, decode_pieces, sample_pieces
from clauseloom.llm.packing import decompose, pack_power_of_two, unpack
from clauseloom.llm.storage import scratch_path

from .cases import empty, frame, rows

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_decompose_cuts_into_powers():
    row, start, length = decompose(np.array([0, 1, 1023, 1024, 2050]), 1024)
    assert [length[row == n].tolist() for n in range(5)] == [[], [1], [512, 256, 128, 64, 32, 16, 8, 4, 2, 1], [1024], [1024, 1024, 2]]
    assert start[row == 4].tolist() == [0, 1024, 2048]


def test_added_tokens_have_the_librarys_ids(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"{end} start", f"x{end}", f"{end}{end} \n {end}", f"two  spaces {end}\nline", end, "plain text here", f"cut {end[:5]} {end[5:]}", f"é{end}日本 語", None, "", f"a {end} b"]
    library = Tokenizer.from_file(BPE)
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for run in (texts, texts[::-1]):
        ids, bounds = BpeEncoder(BPE).encode(pa.array(run, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in run]
    made = list(enumerate(texts))
    want = {d: ids_of(library, t).tobytes() for d, t in made}
    assert {r.doc_id: bytes(r.ids) for r in unpack(pack_power_of_two(frame(spark, made), BPE)).collect()} == want
    path = scratch_path(spark, "test-huffman")
    huffman.write_huffman(frame(spark, made), path, BPE, block_ids=64, interval=8)
    assert {r.doc_id: bytes(r.ids) for r in huffman.read_huffman(spark, path).collect()} == want


def test_packing(spark, tokenizer):
    found = pack_power_of_two(frame(spark), BPE).collect()
    want = Counter(ids_of(tokenizer, t).tobytes() for _, t in rows())
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in found)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)
    assert len({r.sequence_id for r in found}) == len(found)
    assert sum(r.length for r in found) == sum(len(k) // 4 * n for k, n in want.items())
    distinct = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows())], "doc_id long, text string")
    back = {r.doc_id: bytes(r.ids) for r in unpack(pack_power_of_two(distinct, BPE)).collect()}
    assert back == {n: ids_of(tokenizer, t).tobytes() for n, (_, t) in enumerate(rows())}
    assert pack_power_of_two(empty(spark), BPE).count() == 0
    with pytest.raises(ValueError):
        pack_power_of_two(frame(spark), BPE, max_tokens=1000)


def test_huffman_files(spark, tokenizer):
    path = scratch_path(spark, "test-huffman")
    huffman.write_huffman(frame(spark), path, BPE, block_ids=64, interval=8)
    found = huffman.read_huffman(spark, path).orderBy("start").collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in found] == [d for d, _ in order]
    at = 0
    for r, (_, text) in zip(found, order):
        own = ids_of(tokenizer, text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes())) and bytes(r.ids) == own.tobytes()
        at += len(own)
    path = scratch_path(spark, "test-huffman")
    huffman.write_huffman(empty(spark), path, BPE)
    assert huffman.read_huffman(spark, path).count() == 0


@pytest.mark.parametrize("counts", [[], [5], [1, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89], [0, 7, 0, 7]])
def test_code_lengths_are_a_prefix_code(counts):
    lengths = huffman.code_lengths(np.array(counts, np.int64), 5)
    used = np.array(counts) > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= 5
    assert sum(2.0 ** -int(n) for n in lengths[used]) <= 1
    ids = np.repeat(np.arange(len(counts)), counts)
    if len(ids):
        payload, points = huffman.encode_ids(ids, lengths, huffman.canonical_codes(lengths), 3)
        assert (huffman.decode_ids(payload, points, len(ids), 3, *huffman.decode_table(lengths)) == ids).all()


def test_pieces_come_back_and_repeat(spark):
    one = sample_pieces(frame(spark), PIECES)
    two = sample_pieces(frame(spark).repartition(7), PIECES)
    key = lambda df: sorted((str(r.doc_id), r.n_pieces, r.ids_crc32, r.text_crc32) for r in df.collect())
    assert key(one) == key(two) != key(sample_pieces(frame(spark), PIECES, seed=1))
    back = sorted((str(r.doc_id), r.text) for r in decode_pieces(one, PIECES).collect())
    assert back == sorted((str(d), t or "") for d, t in rows())
    assert sample_pieces(empty(spark), PIECES).count() == 0


def test_pieces_are_drawn_by_their_weights():
    lattice, word, draws = PieceLattice(PIECES, 1.0), "hello", 40_000
    pieces = {b: n for n, b in enumerate(lattice.bytes) if b and n not in set(lattice._byte.tolist())}
    ways = {}

    def extend(at, so_far, weight):
        raw = b" " + word.encode()
        if at == len(raw):
            ways[tuple(so_far)] = math.exp(weight)
        for to in range(at + 1, len(raw) + 1):
            if (n := pieces.get(raw[at:to])) is not None:
                extend(to, [*so_far, n], weight + lattice._weight[n])

    extend(0, [], 0.0)
    total = sum(ways.values())
    ids, bounds = lattice.sample(pa.array([word] * draws), np.arange(draws))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:]))
    assert set(seen) <= set(ways)
    assert all(abs(seen[w] / draws - p / total) < 0.012 for w, p in ways.items())


FULL = (1 << 64) - 1


def plain_mix(x, seed=0):
    """The finaliser of splitmix64, on Python's integers."""
    x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & FULL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def plain_samples(docs):
    """Pieces of each text, drawn one word at a time: the sums of all ways to each place, then the last piece, the one before it, and so on."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kept = [n for n in range(model.vocab_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n) or model.is_byte(n))]
    by_rank = sorted(kept, key=lambda n: -model.get_score(n))
    weight = {model.id_to_piece(n).replace("▁", " ").encode(): (n, -math.log(k + 2.0)) for k, n in enumerate(by_rank)}
    rare, longest = -math.log(len(by_rank) + 1.0) - 5, max(map(len, weight))
    byte = {int(model.id_to_piece(n)[3:5], 16): n for n in range(model.vocab_size()) if model.is_byte(n)}
    known = {}

    def edges(word):
        if word not in known:
            alone = {k for at, c in zip(np.cumsum([0, *(len(c.encode()) for c in word.decode())]), word.decode()) if c.encode() not in weight for k in range(at, at + len(c.encode()))}
            total, into = [0.0] + [-math.inf] * len(word), [[] for _ in range(len(word) + 1)]
            for end in range(1, len(word) + 1):
                found = [(start, *weight[word[start:end]]) for start in range(end - 1, max(0, end - longest) - 1, -1) if word[start:end] in weight]
                found += [(end - 1, byte[word[end - 1]], rare)] if end - 1 in alone else []
                found = [(start, n, total[start] + w) for start, n, w in found if total[start] > -math.inf]
                if found:
                    high = max(v for *_, v in found)
                    total[end] = high + math.log(sum(math.exp(v - high) for *_, v in found))
                    upto = np.cumsum([0.0, *(math.exp(v - total[end]) for *_, v in found)])[:-1]
                    into[end] = [(int(min(b, 1) * 2.0**32), start, n) for b, (start, n, _) in zip(upto, found)]
            known[word] = into
        return known[word]

    for d, text, key in docs:
        raw, out = b" " + text.encode() if text else b"", []
        cuts = [n for n in range(1, len(raw)) if raw[n] == 32 != raw[n - 1] or raw[n] == 10 or raw[n - 1] == 10]
        for start, stop in zip([0, *cuts], [*cuts, len(raw)]):
            into, at, step, own = edges(raw[start:stop]), stop - start, 0, []
            seed = plain_mix((key % (1 << 64) + plain_mix(start)) & FULL)
            while at:
                draw = plain_mix(seed, step) >> 32
                _, at, n = [e for e in into[at] if e[0] <= draw][-1]
                own.append(n)
                step += 1
            out += own[::-1]
        yield d, out


def test_registered_query_draws_what_a_plain_sampler_draws(spark):
    from clauseloom.llm import queries

    from .cases import FOLDER

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(doc_id, 0) as key").collect()
    want = {d: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in plain_samples(docs)}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in queries.op4_lattice_sampling(spark, FOLDER).collect()} == want


def test_whole_table_digests(spark):
    from clauseloom.llm import queries

    from .cases import FOLDER

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    t = Tokenizer.from_file(BPE)
    ids = {r.doc_id: ids_of(t, r.text) for r in docs.collect()}
    want = {d: zlib.crc32(own.tobytes()) for d, own in ids.items()}
    assert {r.doc_id: r.ids_crc32 for r in queries.op9_huffman_ids(spark, FOLDER).collect()} == want
    packed = queries.op1_power_of_two_packing(spark, FOLDER).collect()
    reach = dict.fromkeys(ids, 0)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == reach[r.doc_id] and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        reach[r.doc_id] += r.length
    assert reach == {d: len(own) for d, own in ids.items()} and len({r.sequence_id for r in packed}) == len(packed) and {r.offset for r in packed} == {0}
    texts = {r.doc_id: zlib.crc32(r.text.encode()) for r in docs.collect()}
    assert {r.doc_id: r.text_crc32 for r in queries.op4_lattice_sampling(spark, FOLDER).collect()} == texts
