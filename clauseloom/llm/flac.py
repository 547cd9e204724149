"""FLAC streams of 8-bit mono samples, encoded and decoded many frames at a time.

Samples are the bytes of a payload, minus 128. A frame has 576 of them and is constant,
verbatim or the residual of a fixed or linear predictor in partitioned Rice code, whichever is shortest. The seek
table of a longer stream names every ``SEEK_FRAMES``-th frame; decoding follows all of these points side by
side, undoes fixed and other linear predictors, and verifies the header's CRC-8, the frame's
CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .batches import text_slices, utf8
from .buckets import cell_bitmap, in_bitmap
from .storage import discard, staged, written

BLOCK = 576
SEEK_FRAMES = 8
RATE = 8000
#: 2 to this power are the most partitions of a frame.
PARTITION_ORDER = 3
LARGEST_RICE = 8
#: Longer codes are not written; a frame that would need one is coded otherwise.
LONGEST_CODE = 57
#: Orders of a frame's own linear predictors, and bits of their coefficients.
LINEAR_ORDERS, LINEAR_BITS = (8, 16), 5
LINEAR_MOST = max(LINEAR_ORDERS)
NEVER = 1 << 40
#: Frames that are encoded, and decoded, at a time.
GROUP, READ_GROUP = 1024, 16384
MOST_SEEK_BYTES = (1 << 24) - 18
#: Text bytes handled at a time.
SLICE = 1 << 19
#: Bytes of streams that are decoded at a time, or one stream.
READ_SLICE = 8 << 20

#: Fixed values of the format: predictor coefficients by order, and the CRC polynomials.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
CRC8, CRC16 = (0x07, 8), (0x8005, 16)


def _crc_table(poly: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << width) - 1)
    return table


def _crc_reach(poly: int, width: int, longest: int) -> np.ndarray:
    """What a byte adds to the checksum, by how many bytes follow it."""
    table = _crc_table(poly, width)
    out = np.empty((longest, 256), np.uint16)
    now = table
    for n in range(longest):
        out[n] = now
        now = (now << 8 ^ table[now >> (width - 8) & 255]) & ((1 << width) - 1)
    return out


_REACH = {CRC8: _crc_reach(*CRC8, 16), CRC16: _crc_reach(*CRC16, 1024)}


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind: tuple[int, int]) -> np.ndarray:
    """Checksum of every run ``data[start:start + length]``; lengths are positive."""
    reach = _REACH[kind]
    if lengths.max(initial=0) > len(reach):
        reach = _REACH[kind] = _crc_reach(*kind, int(lengths.max()) * 2)
    starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    first = ends - lengths
    inside = np.arange(ends[-1]) - np.repeat(first, lengths)
    terms = reach[np.repeat(lengths, lengths) - 1 - inside, data[np.repeat(starts, lengths) + inside]]
    return np.bitwise_xor.reduceat(terms, first)


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (up to 6) and how many."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    out = np.zeros((len(n), 6), np.int64)
    for k in range(6):
        shift = 6 * (size - 1 - k)
        lead = np.where(size == 1, n, (0xFF00 >> size & 0xFF) | n >> np.maximum(shift, 0))
        out[:, k] = np.where(k == 0, lead, 0x80 | n >> np.maximum(shift, 0) & 0x3F)
    return out, size


def _best(best: dict[str, np.ndarray], folded: np.ndarray, order: int, head: int, shift: np.ndarray | None = None, taps: np.ndarray | None = None) -> None:
    """Take the frames that this predictor codes in fewer bits than those before it. ``head`` are the bits of its warm-up and coefficients."""
    frames, parts = len(folded), 1 << PARTITION_ORDER
    cells = folded.reshape(frames, parts, -1)
    count = np.full(parts, BLOCK // parts)
    count[0] -= order
    most = cells.max(axis=2)
    cost = np.empty((frames, parts, LARGEST_RICE + 1), np.int64)
    for k in range(LARGEST_RICE + 1):
        cost[:, :, k] = (cells >> k).sum(axis=2) + (k + 1) * count
        cost[:, :, k][(most >> k) + k + 1 > LONGEST_CODE] = NEVER
    # partitions of one parameter from the finest on: neighbours are joined while that saves bits
    bits = np.full(frames, NEVER)
    rice = np.zeros((frames, parts), np.int64)
    split = np.zeros(frames, np.int64)
    for p in range(PARTITION_ORDER, -1, -1):
        k = cost.argmin(axis=2)
        total = np.take_along_axis(cost, k[:, :, None], axis=2)[:, :, 0].sum(axis=1) + 4 * (1 << p) + 6 + head
        on = total < bits
        bits[on], split[on] = total[on], p
        rice[on] = np.repeat(k, parts >> p, axis=1)[on]
        if p:
            cost = cost[:, ::2] + cost[:, 1::2]
    on = bits < best["bits"]
    best["bits"][on], best["split"][on], best["rice"][on], best["folded"][on] = bits[on], split[on], rice[on], folded[on]
    best["order"][on], best["linear"][on] = order, taps is not None
    if taps is not None:
        best["shift"][on], best["taps"][on] = shift[on], taps[on]


def _folded(residual: np.ndarray, order: int) -> np.ndarray:
    out = residual << 1 ^ residual >> 31
    out[:, :order] = 0
    return out


def _linear(samples: np.ndarray, lags: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of each frame's own linear predictor, its shift and its coefficients, from the frame's autocorrelation."""
    apart = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
    exact = np.linalg.solve(lags[:, apart], lags[:, 1 : order + 1, None])[:, :, 0]
    limit = 1 << (LINEAR_BITS - 1)
    shift = np.clip(LINEAR_BITS - 1 - np.ceil(np.log2(np.abs(exact).max(axis=1) + 1e-9)), 0, 15).astype(np.int64)
    taps = np.clip(np.round(exact * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32)
    guess = np.zeros_like(samples)
    for i in range(order):
        guess[:, i + 1 :] += taps[:, i : i + 1] * samples[:, : BLOCK - 1 - i]
    return samples - (guess >> shift[:, None].astype(np.int32)), shift, np.pad(taps, ((0, 0), (0, LINEAR_MOST - order)))


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames on end, and each frame's length. ``samples`` is (frames, 576) int32.

    Each frame takes what codes it in the fewest bits: fixed predictors of orders 0 to 4 or one of its own linear ones,
    1 to 8 partitions, and in each the best of all Rice parameters.
    """
    frames, parts = len(samples), 1 << PARTITION_ORDER
    best = {"bits": np.full(frames, NEVER), "folded": np.zeros((frames, BLOCK), np.int64), "taps": np.zeros((frames, LINEAR_MOST), np.int64), "rice": np.zeros((frames, parts), np.int64)}
    best |= {name: np.zeros(frames, np.int64) for name in ("split", "order", "linear", "shift")}
    diff = samples
    for order in FIXED:
        _best(best, _folded(diff, order), order, 8 * order)
        diff = np.diff(diff, axis=1, prepend=0)
    exact = samples.astype(np.float64)
    lags = np.stack([(exact[:, k:] * exact[:, : BLOCK - k]).sum(axis=1) for k in range(LINEAR_MOST + 1)], axis=1)
    lags[:, 0] = lags[:, 0] * 1.0001 + 1
    for order in LINEAR_ORDERS:
        residual, shift, taps = _linear(samples, lags, order)
        _best(best, _folded(residual, order), order, (8 + LINEAR_BITS) * order + 9, shift, taps)
    order, linear, rice, folded = best["order"], best["linear"].astype(bool), best["rice"], best["folded"]
    k = np.repeat(rice, BLOCK // parts, axis=1)
    size = (folded >> k) + 1 + k
    code = (1 << k) | (folded & ((1 << k) - 1))
    size[np.arange(BLOCK) < order[:, None]] = 0
    constant = (samples == samples[:, :1]).all(axis=1)
    verbatim = ~constant & (best["bits"] >= 8 * BLOCK)
    plain = constant | verbatim
    order[plain], linear[plain] = 0, False
    byte = samples & 0xFF
    size = np.where(verbatim[:, None], 8, size)
    code = np.where(verbatim[:, None], byte, code)
    size[constant] = 0
    size[constant, 0] = 8
    code[constant, 0] = byte[constant, 0]

    text, digits = _number(number)
    head = np.concatenate([np.tile([0xFF, 0xF8, 0x24, 0x02], (frames, 1)), text, np.zeros((frames, 1), np.int64)], axis=1)
    used = np.arange(11) < (4 + digits)[:, None]
    head[np.arange(frames), 4 + digits] = checksums(head[used].astype(np.uint8), np.cumsum(4 + digits) - (4 + digits), 4 + digits, CRC8)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31 + order, 8 | order))) << 1
    warm = np.arange(LINEAR_MOST) < order[:, None]
    pieces = [head, kind[:, None], np.where(warm, byte[:, :LINEAR_MOST], 0), ((LINEAR_BITS - 1) << 5 | best["shift"])[:, None], best["taps"] & ((1 << LINEAR_BITS) - 1)]
    widths = [8 * (np.arange(11) < (5 + digits)[:, None]), np.full((frames, 1), 8), 8 * warm, np.where(linear, 9, 0)[:, None], LINEAR_BITS * (warm & linear[:, None])]
    for p in range(parts):
        opens = ~plain & (p % (parts >> best["split"]) == 0)
        pieces += [(rice[:, p] | (best["split"] << 4 if p == 0 else 0))[:, None], code[:, p * BLOCK // parts : (p + 1) * BLOCK // parts]]
        widths += [np.where(opens, 10 if p == 0 else 4, 0)[:, None], size[:, p * BLOCK // parts : (p + 1) * BLOCK // parts]]
    code, size = np.concatenate(pieces, axis=1), np.concatenate(widths, axis=1).astype(np.int64)
    code[size == 0] = 0
    inside = np.cumsum(size, axis=1)
    body = (inside[:, -1] + 7) // 8
    start = np.cumsum(body + 2) - (body + 2)
    offsets = (inside - size) + 8 * start[:, None]
    data = bits.pack(code.ravel(), size.ravel(), offsets.ravel(), int(8 * (body + 2).sum())).copy()
    crc = checksums(data, start, body, CRC16)
    data[start + body], data[start + body + 1] = crc >> 8, crc & 255
    return data, body + 2


def encode_streams(payloads: Iterable[np.ndarray]) -> Iterator[bytes]:
    """A FLAC stream of each payload; payloads are whole, positive multiples of 576 bytes. ``GROUP`` frames are encoded at a time, of one long payload or of several short ones."""
    held: list[np.ndarray] = []
    for payload in payloads:
        held.append(payload)
        if sum(map(len, held)) >= GROUP * BLOCK:
            yield from _streams(held)
            held = []
    if held:
        yield from _streams(held)


def _streams(payloads: list[np.ndarray]) -> Iterator[bytes]:
    counts = np.array([len(p) // BLOCK for p in payloads])
    whole = np.concatenate(payloads) if len(payloads) > 1 else payloads[0]
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    made = [encode_frames(whole[at * BLOCK : (at + GROUP) * BLOCK].astype(np.int32).reshape(-1, BLOCK) - 128, number[at : at + GROUP]) for at in range(0, len(number), GROUP)]
    data, sizes = b"".join(d.tobytes() for d, _ in made), np.concatenate([n for _, n in made])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    for payload, n in zip(payloads, counts.tolist()):
        own = sizes[first : first + n]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(payload ^ 0x80).digest()
        # a block of metadata has 24 bits for its size; a table of one point would say nothing
        step = max(SEEK_FRAMES, -(-18 * n // MOST_SEEK_BYTES))
        points = b"".join(struct.pack(">QQH", f * BLOCK, int(ends[first + f] - ends[first]), BLOCK) for f in range(0, n, step))
        table = b"\x83" + len(points).to_bytes(3, "big") + points if n > step else b""
        yield b"fLaC" + (b"\x00" if table else b"\x80") + len(info).to_bytes(3, "big") + info + table + data[ends[first] : ends[first + n]]
        first += n


def _read(window: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The next ``n`` (24 at most) bits of each lane as numbers; 0 where ``n`` is 0."""
    n = np.asarray(n)
    return ((window[at >> 3] << (at & 7).astype(np.uint32)).astype(np.int64) & 0xFFFFFFFF) >> (32 - n)


def _signed(value: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return np.where(value >> (np.asarray(n) - 1) & 1, value - (1 << np.asarray(n)), value)


_ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames, 576) int32, frame numbers and the byte after each frame, of frames that start at ``starts``.

    Reads 8-bit mono frames of 576 samples with constant, verbatim, fixed or general linear
    prediction subframes. Raises ``ValueError`` on a checksum or header that does not hold.
    """
    window = bits.windows(data)
    limit = 8 * len(data)
    lanes = len(starts)
    first = data[starts + 4].astype(np.int64)
    if not ((data[starts] == 0xFF) & (data[starts + 1] == 0xF8) & (data[starts + 2] >> 4 == 2) & (data[starts + 3] & 0xFE == 2)).all():
        raise ValueError("not a frame of 576 8-bit mono samples")
    digits = np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC], [1, 2, 3, 4, 5], 6)
    number = np.where(digits == 1, first, first & (0x7F >> digits))
    for k in range(1, 6):
        more = k < digits
        number = np.where(more, number << 6 | data[np.minimum(starts + 4 + k, len(data) - 1)] & 0x3F, number)
    if (checksums(data, starts, 4 + digits, CRC8) != data[starts + 4 + digits]).any():
        raise ValueError("a frame header's CRC-8 does not hold")
    at = 8 * (starts + 5 + digits).astype(np.int64)
    kind = _read(window, at, 8) >> 1
    at = at + 8
    constant, verbatim, linear = kind == 0, kind == 1, kind >= 32
    order = np.where(linear, kind - 31, np.where(constant | verbatim, 0, kind & 7))
    if ((kind > 1) & (kind < 8) | (kind > 12) & ~linear).any():
        raise ValueError("a reserved subframe type")
    depth = int(order.max(initial=0))
    taps = np.zeros((depth, lanes), np.int64)
    for o in range(1, 5):
        for i, c in enumerate(FIXED[o][:depth]):
            taps[i, (order == o) & ~linear] = c
    shift = np.zeros(lanes, np.int64)
    out = np.zeros((BLOCK, lanes), np.int64)
    for t in range(depth):
        on = t < order
        out[t] = np.where(on, _signed(_read(window, at, 8), 8), 0)
        at = at + 8 * on
    if linear.any():
        width = np.where(linear, _read(window, at, 4) + 1, 1)
        shift = np.where(linear, _read(window, at + 4, 5), 0)
        at = at + 9 * linear
        for i in range(depth):
            on = linear & (i < order)
            taps[i] = np.where(on, _signed(_read(window, at, width), width), taps[i])
            at = at + width * on
    coded = ~(constant | verbatim)
    wide = np.where(coded & (_read(window, at, 2) == 1), 5, 4)
    length = np.where(coded, BLOCK >> _read(window, at + 2, 4), BLOCK)
    at = at + 6 * coded
    rice, raw = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    escaped = np.zeros(lanes, bool)
    any_escape = False
    for t in range(BLOCK):
        on = coded & (t >= order)
        opens = on & ((t == order) | (t % length == 0))
        if opens.any():
            rice = np.where(opens, _read(window, at, wide), rice)
            at = at + wide * opens
            escaped = np.where(opens, rice == (1 << wide) - 1, escaped)
            own = opens & escaped
            if own.any():
                raw = np.where(own, _read(window, at, 5), raw)
                at = at + 5 * own
            any_escape = bool(escaped.any())
            unary = on & ~escaped
        elif t <= depth:
            unary = on & ~escaped
        high = _ZEROS[_read(window, at, 16)]
        more = unary & (high == 16)
        seen = at
        while more.any():
            seen = np.minimum(seen + 16 * more, limit)
            step = _ZEROS[_read(window, seen, 16)]
            high = high + step * more
            more &= (step == 16) & (seen < limit)
        k = np.where(unary, rice, 0)
        at = np.minimum(at + (high + 1) * unary, limit)
        folded = high << k | _read(window, at, k)
        at = at + k
        value = folded >> 1 ^ -(folded & 1)
        if any_escape:
            own = on & escaped
            value = np.where(own, np.where(raw > 0, _signed(_read(window, at, raw), np.maximum(raw, 1)), 0), value)
            at = at + raw * own
        if not on.all():
            plain = verbatim | constant & (t == 0)
            literal = _signed(_read(window, at, 8), 8)
            value = np.where(on, value, np.where(plain, literal, out[t - 1] if t else 0))
            at = at + 8 * plain
            value = np.where(coded & ~on, out[t], value)
        if depth:
            back = min(depth, t)
            guess = (taps[:back] * out[t - 1 :: -1][:back]).sum(axis=0) if back else 0
            value = value + np.where(on, guess >> shift, 0)
        out[t] = value
    ends = (at + 7) >> 3
    body = ends - starts
    if (ends + 2 > len(data)).any() or (checksums(data, starts, body, CRC16) != (data[ends].astype(np.int64) << 8 | data[ends + 1])).any():
        raise ValueError("a frame's CRC-16 does not hold")
    return out.T.astype(np.int32), number, ends + 2


def _head(s: memoryview) -> tuple[int, bytes, int, list[tuple[int, int]]]:
    """Samples of a stream, their MD5, where its frames start, and its seek points: sample and byte after that start."""
    if s[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, table = 4, False, b"", b""
    while not last:
        last, kind, size = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        body = bytes(s[at + 4 : at + 4 + size])
        info, table = (body, table) if kind == 0 else (info, body) if kind == 3 else (info, table)
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 0xFF != 7:
        raise ValueError("only 8-bit mono streams are read")
    points = [struct.unpack(">QQ", table[p : p + 16]) for p in range(0, len(table), 18)]
    return packed & (1 << 36) - 1, info[18:34], at, points or [(0, 0)]


def decode_pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pieces of all streams ``data[bounds[n]:bounds[n + 1]]`` in order: the stream, the first sample and the samples as bytes (sample + 128).

    Frames from some seek points on are decoded side by side, so many that their streams take ``READ_GROUP`` frames in all, about, and
    no more where a stream is long. Every checksum is verified; a stream's MD5 when its last piece has been handed on.
    """
    view = memoryview(data)
    heads = [_head(view[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    lanes = [(n, s, e, int(bounds[n]) + at + o) for n, (total, _, at, own) in enumerate(heads) for (s, o), e in zip(own, [*(p[0] for p in own[1:]), total])]
    sums, first = {n: hashlib.md5() for n in range(len(heads))}, 0
    while first < len(lanes):
        last, room = first, 0
        while last < len(lanes) and (last == first or room + lanes[last][2] - lanes[last][1] <= READ_GROUP * BLOCK):
            room += lanes[last][2] - lanes[last][1]
            last += 1
        low = lanes[first][3]
        part = data[low : lanes[last][3] if last < len(lanes) else len(data)]
        own = np.array(lanes[first:last], np.int64)
        target, upto, where = np.cumsum(own[:, 2] - own[:, 1]) - (own[:, 2] - own[:, 1]) - own[:, 1], own[:, 2], own[:, 3] - low
        samples = np.empty(room, np.uint8)
        while len(where):
            found, number, where = decode_frames(part, where)
            samples[(target + number * BLOCK)[:, None] + np.arange(BLOCK)] = found + 128
            on = (number + 1) * BLOCK < upto
            where, target, upto = where[on], target[on], upto[on]
        at = 0
        for n in np.unique(own[:, 0]).tolist():
            mine = own[own[:, 0] == n]
            size = int((mine[:, 2] - mine[:, 1]).sum())
            piece = samples[at : at + size]
            sums[n].update(piece ^ 0x80)
            yield n, int(mine[0, 1]), piece
            if mine[-1, 2] == heads[n][0] and sums.pop(n).digest() != heads[n][1]:
                raise ValueError("a stream's MD5 does not hold")
            at += size
        first = last


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream as bytes (sample + 128)."""
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for n, _, piece in decode_pieces(np.frombuffer(b"".join(streams), np.uint8), np.cumsum([0, *map(len, streams)])):
        out[n].append(piece)
    return [np.concatenate(pieces) for pieces in out]


def payloads_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each text, then bytes 255 up to a positive multiple of 576."""
    raw, bounds = utf8(texts)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        fill = -(b - a) % BLOCK if b > a else BLOCK
        yield np.concatenate([raw[a:b], np.full(fill, 255, np.uint8)])


def encode_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, n_bytes (of the text) and media (a FLAC stream of its padded bytes) of every row.

    A null or empty text has one frame of padding. Repeated rows give repeated streams, an
    empty table none. Nothing is shuffled. Other columns are not read. A task holds one text and its stream
    and ``GROUP`` frames on their way, however long the text.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sizes = np.diff(utf8(batch["text"])[1])
            media = pa.array(encode_streams(payloads_of(batch["text"])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["key"], *(batch[c] for c in carry), pa.array(sizes), media], names=["key", *carry, "n_bytes", "media"])

    key = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    rows = docs.select(F.col(id_col).alias("key"), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"key {key}, {kinds}n_bytes long, media binary").withColumnRenamed("key", id_col)


def decode_flac(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", block_samples: int = BLOCK * 8) -> DataFrame:
    """PCM blocks of every stream: ``id_col``, sample_offset, n_samples, pcm (signed 8-bit). A null stream has no blocks; a damaged one raises."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "media", READ_SLICE):
            left: dict[int, bytes] = {}
            for n, first, piece in decode_pieces(*utf8(batch["media"])):
                held = left.pop(n, b"")
                signed = held + (piece ^ 0x80).tobytes()
                first -= len(held)
                whole = [signed[at : at + block_samples] for at in range(0, len(signed), block_samples)]
                if len(whole[-1]) < block_samples:
                    left[n] = whole.pop()
                yield blocks(batch["key"].slice(n, 1), first, whole)
                # what is left is a last block where no more of the stream follows
                for m in [m for m in left if m < n]:
                    yield blocks(batch["key"].slice(m, 1), ends[m] - len(left[m]), [left.pop(m)])
                ends[n] = first + len(signed)
            for m, rest in left.items():
                yield blocks(batch["key"].slice(m, 1), ends[m] - len(rest), [rest])
            ends.clear()

    ends: dict[int, int] = {}

    def blocks(key: pa.Array, first: int, found: list[bytes]) -> pa.RecordBatch:
        offsets = [first + n * block_samples for n in range(len(found))]
        return pa.RecordBatch.from_arrays(
            [key.take(pa.array([0] * len(found), pa.int64())), pa.array(offsets, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.binary())], names=["key", "sample_offset", "n_samples", "pcm"]
        )

    key = media.schema[id_col].dataType.simpleString()
    rows = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(media_col).alias("media"))
    return rows.mapInArrow(decode, f"key {key}, sample_offset long, n_samples long, pcm binary").withColumnRenamed("key", id_col)


def write_pcm(media: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "media", block_samples: int = BLOCK * 8) -> None:
    """Write the PCM blocks of :func:`decode_flac` as a table that a reader can seek in: its files' statistics of id and sample_offset say which hold a sample."""
    blocks = decode_flac(media, id_col, media_col, block_samples)
    blocks.sortWithinPartitions(id_col, "sample_offset").write.parquet(path)


def read_samples(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The blocks of :func:`write_pcm` that hold any of the samples ``first`` to ``last``."""
    return spark.read.parquet(path).where((F.col("sample_offset") <= last) & (F.col("sample_offset") + F.col("n_samples") > first))


class _Features:
    """Sums over the samples of a stream, a piece at a time."""

    def __init__(self):
        self.digest, self.tail, self.n, self.total, self.energy, self.crossings, self.peak, self.below = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, piece: np.ndarray) -> None:
        self.digest.update(piece)
        self.tail = (self.tail + piece[-32:].tobytes())[-32:]
        signed = piece.astype(np.int32) - 128
        below = signed < 0
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.below is not None and self.below != bool(below[0]))
        self.below = bool(below[-1])
        self.n, self.total, self.energy = self.n + len(piece), self.total + int(signed.sum()), self.energy + int((signed * signed).sum(dtype=np.int64))
        self.peak = max(self.peak, int(np.abs(signed).max()))

    def row(self, stream: memoryview) -> tuple:
        text = f"sum={self.total};energy={self.energy};crossings={self.crossings};peak={self.peak}"
        return self.n, self.digest.hexdigest(), zlib.crc32(self.tail), len(stream), hashlib.sha256(stream).hexdigest(), text


def flac_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Each stream decoded again and summed up: ``id_col``, the columns ``carry``, payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes, media_sha256 and feature (sum, energy, zero crossings and peak of the samples)."""

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "media", READ_SLICE):
            data, bounds = utf8(batch["media"])
            sums = [_Features() for _ in range(batch.num_rows)]
            for n, _, piece in decode_pieces(data, bounds):
                sums[n].add(piece)
            rows = [own.row(memoryview(data)[a:b]) for own, a, b in zip(sums, bounds.tolist(), bounds[1:].tolist())]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch["key"], *(batch[c] for c in carry), *columns], names=names)

    names = ["key", *carry, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    key = media.schema[id_col].dataType.simpleString()
    rows = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("key"), *carry, F.col(media_col).alias("media"))
    kinds = "".join(f"{c} {media.schema[c].dataType.simpleString()}, " for c in carry) + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(features, f"key {key}, {kinds}").withColumnRenamed("key", id_col)


def store_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Streams in the shared folder, those of equal texts once: ``media`` (``id_col``, digest where shared, shared, n_bytes, media) and ``copies`` (``id_col``, digest) of the rows that have none of their own.

    The stream of equal texts is that of the row whose id is smallest. Which rows go without is told by two bitmaps of fixed size;
    a row is left out only where both are sure, so at worst a text is stored again. shared is true
    wherever there are copies. Texts are not shuffled, only 128-bit digests of them.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("digest")
    keys, path = written(docs.select(F.col(id_col).alias("key"), digest), "digests")
    own = F.xxhash64("key", "digest")
    several = keys.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = staged(keys.join(several, "digest").where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "digest"), "copies")
    maybe = cell_bitmap(copies.select(own.alias("cell")), F.col("cell"))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(maybe.value, np.asarray(batch["cell"]))))

    met = keys.select("key", "digest", own.alias("cell")).mapInArrow(look, f"key {docs.schema[id_col].dataType.simpleString()}, digest binary, cell long")
    same = copies.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))
    kept = met.join(same, met["key"].eqNullSafe(same["__key"]) & (met["digest"] == same["__digest"]), "left_anti")
    surely = cell_bitmap(kept.select("cell"), F.col("cell"))
    held = cell_bitmap(copies.select(F.xxhash64("digest").alias("cell")), F.col("cell"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch["cell"])
            left_out = in_bitmap(maybe.value, cell) & ~in_bitmap(surely.value, cell)
            shared = in_bitmap(held.value, np.asarray(batch["shared"]))
            digests = pc.if_else(pa.array(shared), batch["digest"], pa.scalar(None, pa.binary()))
            columns = [batch["key"], digests, pa.array(shared), batch["text"]]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~left_out))

    key = docs.schema[id_col].dataType.simpleString()
    names = ["key", "digest", "shared", "text"]
    rows = docs.select(F.col(id_col).alias("key"), digest, F.xxhash64(digest).alias("shared"), F.xxhash64(F.col(id_col), digest).alias("cell"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = rows.mapInArrow(mark, f"key {key}, digest binary, shared boolean, text string")
    discard(docs.sparkSession, path)
    # heads of streams and frames are much alike, and words recur where residuals do
    media = staged(encode_flac(chosen, "key", "text", ("digest", "shared")), "media", "zstd")

    def without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~in_bitmap(surely.value, np.asarray(batch["cell"])))).select(["key", "digest"])

    others = copies.select("key", "digest", own.alias("cell")).mapInArrow(without, f"key {key}, digest binary")
    return media.withColumnRenamed("key", id_col), others.withColumnRenamed("key", id_col)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`flac_features` of every row of ``docs`` from stored streams: ``id_col``, n_bytes and what it returns. Equal texts have one stream and equal values.

    A null text is an empty one. Rows that repeat, or whose id is null, are answered each; an empty table gives no rows. Other columns are not read.
    """
    media, copies = store_flac(docs, id_col, text_col)
    kept = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    each = flac_features(media, id_col).select(id_col, *kept)
    shared = flac_features(media.where("shared"), id_col, carry=("digest", "n_bytes")).select("digest", *kept).dropDuplicates(["digest"])
    return each.unionByName(copies.join(shared, "digest").select(id_col, *kept))
