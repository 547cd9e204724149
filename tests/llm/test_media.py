"""FLAC against a writer and a reader that share nothing with the library: one sample at a time, bits in a string."""

import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from clauseloom.llm import flac, queries

from .cases import FOLDER, empty, frame, rows

COEFFICIENTS = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc(data, poly, width):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return value


def number(n):
    """The format's frame numbers are coded as UTF-8 codes characters."""
    return chr(n).encode("utf-8", "surrogatepass")


def signed(value, width):
    return format(value & ((1 << width) - 1), f"0{width}b") if width else ""


def rice(residual, order, k_of, partition_order, five_bits, escape):
    """Residuals in partitions; those that ``escape`` names are written plainly."""
    out, k_width = f"{int(five_bits):02b}{partition_order:04b}", 5 if five_bits else 4
    size = 576 >> partition_order
    for p in range(1 << partition_order):
        part = residual[max(p * size, order) - order : (p + 1) * size - order]
        if p in escape:
            width = max((max(x, ~x).bit_length() + 1 for x in part if x), default=0)
            out += "1" * k_width + f"{width:05b}" + "".join(signed(x, width) for x in part)
            continue
        k = k_of(p)
        out += format(k, f"0{k_width}b")
        for x in part:
            folded = 2 * x if x >= 0 else -2 * x - 1
            out += "0" * (folded >> k) + "1" + (format(folded & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def subframe(samples, how, rng):
    if how == "constant":
        return "00000000" + signed(samples[0], 8)
    if how == "verbatim":
        return "00000010" + "".join(signed(x, 8) for x in samples)
    kind, order = how
    head = f"0{(8 | order) if kind == 'fixed' else (31 + order):06b}0" + "".join(signed(x, 8) for x in samples[:order])
    taps, shift = COEFFICIENTS.get(order), 0
    if kind == "linear":
        width, shift = 7, 4
        taps = [rng.randint(-20, 20) for _ in range(order)]
        head += f"{width - 1:04b}{shift:05b}" + "".join(signed(c, width) for c in taps)
    residual = [samples[t] - (sum(c * samples[t - 1 - i] for i, c in enumerate(taps)) >> shift) for t in range(order, 576)]
    partitions = rng.choice([0, 1, 3])
    return head + rice(residual, order, lambda p: rng.choice([2, 5, 7]), partitions, rng.random() < 0.5, {p for p in range(1 << partitions) if rng.random() < 0.3})


def stream(payload, hows, rng, points):
    frames = []
    for n, how in enumerate(hows):
        samples = [b - 128 for b in payload[576 * n : 576 * n + 576]]
        head = b"\xff\xf8\x24\x02" + number(n)
        head += bytes([crc(head, 0x07, 8)])
        bits = subframe(samples, how, rng)
        bits += "0" * (-len(bits) % 8)
        body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        frames.append(body + crc(body, 0x8005, 16).to_bytes(2, "big"))
    info = (576).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(bytes(b ^ 0x80 for b in payload)).digest()
    seeks = b"".join((576 * n).to_bytes(8, "big") + sum(map(len, frames[:n])).to_bytes(8, "big") + (576).to_bytes(2, "big") for n in points)
    table = b"\x83" + len(seeks).to_bytes(3, "big") + seeks if points else b""
    return b"fLaC" + (b"\x00" if points else b"\x80") + len(info).to_bytes(3, "big") + info + table + b"".join(frames)


def read(raw):
    """Samples plus 128 of a stream, its frames one behind the other."""
    assert raw[:4] == b"fLaC"
    at, last, blocks = 4, False, {}
    while not last:
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        blocks[kind] = raw[at + 4 : at + 4 + size]
        at += 4 + size
    total = int.from_bytes(blocks[0][10:18], "big") & ((1 << 36) - 1)
    first, starts, out = at, {}, []
    while len(out) < total:
        begin = at
        starts[len(out)] = begin - first
        at += 4
        length = len(number(len(out) // 576))
        assert raw[begin : begin + 4] == b"\xff\xf8\x24\x02" and raw[at : at + length] == number(len(out) // 576)
        at += length
        assert crc(raw[begin:at], 0x07, 8) == raw[at]
        bits, p = format(int.from_bytes(raw[at + 1 : at + 9000], "big"), "b").zfill(8 * len(raw[at + 1 : at + 9000])), 0

        def take(n):
            nonlocal p
            p += n
            return int(bits[p - n : p], 2) if n else 0

        def signed_take(n):
            value = take(n)
            return value - (1 << n) if n and value >> (n - 1) else value

        kind = take(8) >> 1
        if kind == 0:
            own = [signed_take(8)] * 576
        elif kind == 1:
            own = [signed_take(8) for _ in range(576)]
        else:
            assert 8 <= kind <= 12 or kind >= 32
            order = kind - 31 if kind >= 32 else kind & 7
            own = [signed_take(8) for _ in range(order)]
            taps, shift = COEFFICIENTS.get(order), 0
            if kind >= 32:
                width, shift = take(4) + 1, take(5)
                taps = [signed_take(width) for _ in range(order)]
            assert take(2) == 0
            parts = take(4)
            for q in range(1 << parts):
                k = take(4)
                for _ in range((576 >> parts) - (order if q == 0 else 0)):
                    high = bits.index("1", p) - p
                    p += high + 1
                    folded = high << k | take(k)
                    own.append((folded >> 1 ^ -(folded & 1)) + (sum(c * own[-1 - i] for i, c in enumerate(taps)) >> shift))
        out += own
        at += 1 + -(-p // 8)
        assert crc(raw[begin:at], 0x8005, 16) == int.from_bytes(raw[at : at + 2], "big")
        at += 2
    assert at == len(raw) and hashlib.md5(bytes(x & 255 for x in out)).digest() == blocks[0][18:34]
    for n in range(0, len(blocks.get(3, b"")), 18):
        sample, offset = (int.from_bytes(blocks[3][n + 8 * i : n + 8 * i + 8], "big") for i in (0, 1))
        assert starts[sample] == offset
    return bytes(x + 128 for x in out)


def noise(rng, frames):
    return bytes(max(0, min(255, int(128 + 60 * np.sin(n / 9) + rng.gauss(0, 6)))) for n in range(576 * frames))


@pytest.mark.parametrize("seed", range(4))
def test_streams_of_another_writer_are_decoded(seed):
    rng = random.Random(seed)
    hows = ["constant", "verbatim", *(("fixed", o) for o in range(5)), *(("linear", o) for o in (1, 2, 7, 12))]
    rng.shuffle(hows)
    payload = bytearray(noise(rng, len(hows)))
    flat = hows.index("constant")
    payload[576 * flat : 576 * flat + 576] = bytes([rng.randrange(256)]) * 576
    for points in ([], [0, 3, 7]):
        raw = stream(bytes(payload), hows, rng, points)
        assert flac.decode_streams([raw, raw])[1].tobytes() == bytes(payload)


def test_another_reader_decodes_the_streams():
    rng = random.Random(9)
    payloads = [noise(rng, 9), bytes([200]) * 576, bytes(rng.randrange(256) for _ in range(1152)), bytes(576) + b"\xff" * 576, noise(rng, 135)]
    for payload, raw in zip(payloads, flac.encode_streams([np.frombuffer(p, np.uint8) for p in payloads])):
        assert read(raw) == payload


def test_frames_take_the_best_that_they_could(monkeypatch):
    rng = random.Random(3)
    text = np.frombuffer(b"".join(bytes(rng.choice(b"etaoin shrdlu")) for _ in range(9)) + bytes(rng.choice(b"etaoin shrdlu") for _ in range(576 * 12)), np.uint8)[: 576 * 12]
    samples = text.astype(np.int32).reshape(-1, 576) - 128
    sizes = flac.encode_frames(samples, np.arange(12))[1]
    for row, size in zip(samples.tolist(), sizes.tolist()):
        best = 8 * 576
        for order, taps in COEFFICIENTS.items():
            residual = [row[t] - sum(c * row[t - 1 - i] for i, c in enumerate(taps)) for t in range(order, 576)]
            folded = [2 * x if x >= 0 else -2 * x - 1 for x in residual]
            for p in range(4):
                width, bits = 576 >> p, 6 + 8 * order
                for q in range(1 << p):
                    part = folded[max(q * width - order, 0) : (q + 1) * width - order]
                    bits += 4 + min(sum((x >> k) + 1 + k for x in part) for k in range(9))
                best = min(best, bits)
        assert size <= 5 + 1 + 1 + -(-best // 8) + 2


MEMORY = """
import hashlib, resource, sys
import numpy as np, pyarrow as pa
from clauseloom.llm import flac
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
size = 32 << 20
text = pa.array([(b"abcdefghij klmnop " * (size // 18 + 1))[:size].decode()])
raw = next(iter(flac.encode_streams(flac.payloads_of(text))))
digest, n = hashlib.sha256(), 0
for stream, first, piece in flac.decode_pieces(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])):
    assert (stream, first) == (0, n)
    digest.update(piece)
    n += len(piece)
payload = next(flac.payloads_of(text)).tobytes()
assert n == len(payload) and digest.digest() == hashlib.sha256(payload).digest()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_a_text_of_32_mb_is_taken_in_bounded_memory():
    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 600  # MB; the text, its payload and its stream are 100 of them


def test_equal_texts_are_stored_once(spark):
    texts = [(n, f"text {n % 40} " * (n % 7)) for n in range(300)] + [(5, "text 5 " * 5), (None, "text 1 "), (None, None), (900, None), (901, "")]
    media, copies = flac.store_flac(frame(spark, texts))
    stored = [(r.doc_id, r.shared) for r in media.collect()]
    assert len(stored) + copies.count() == len(texts) and len(stored) <= len({t or "" for _, t in texts}) + 5
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.payload_sha256) for r in flac.media_features(frame(spark, texts)).collect())
    padded = lambda raw: raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    assert found == sorted(((d is None, d or 0), len((t or "").encode()), hashlib.sha256(padded((t or "").encode())).hexdigest()) for d, t in texts)
    assert flac.media_features(empty(spark)).count() == 0 and flac.media_features(frame(spark)).count() == len(rows())


def test_pcm_blocks_of_all_sizes(spark):
    rng = random.Random(5)
    texts = [(n, "".join(rng.choice("abc déf") for _ in range(rng.choice([0, 5, 700, 5000, 30_000])))) for n in range(25)]
    media = flac.encode_flac(frame(spark, texts))
    for size in (576 * 8, 1000):
        held = {}
        for r in sorted(flac.decode_flac(media, block_samples=size).collect(), key=lambda r: (r.doc_id, r.sample_offset)):
            assert r.sample_offset % size == 0 and r.n_samples == len(r.pcm) and r.sample_offset == len(held.get(r.doc_id, b""))
            held[r.doc_id] = held.get(r.doc_id, b"") + bytes(b ^ 0x80 for b in r.pcm)
        for d, t in texts:
            raw = t.encode()
            assert held[d] == raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op10_flac_media(spark, FOLDER).collect()}
    media = {r.doc_id: bytes(r.media) for r in flac.encode_flac(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert set(found) == set(docs)
    for d, text in docs.items():
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:])) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(media[d]), hashlib.sha256(media[d]).hexdigest())
        if len(payload) <= 576 * 6:
            assert read(media[d]) == payload
        samples = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert r.feature == f"sum={sum(samples)};energy={sum(x * x for x in samples)};crossings={crossings};peak={max(map(abs, samples))}"
