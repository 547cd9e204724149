"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, repeated words and
repeated lines, with those of the line before and after it. Forward-backward marginals, weighted
by line length, make up the document's value, which a logistic curve turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mix, runs, text_slices, utf8
from .bpe import rest
from .hashes import piece_hashes

FEATURES = ("length", "upper", "digit", "mark", "exclamation", "bar", "symbol", "space", "word_length", "repeated_words", "repeated_line", "first", "last", "bias")
SLICE = 1 << 18
#: Lines of a block in training; a document of more lines is several.
BLOCK_LINES = 128
#: Shares are weighed up, so that a tenth of a line counts as much as a mark that is there or not.
SHARE = 10

_KIND = np.zeros(256, np.uint8)  # 0: letters and everything beyond ASCII
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?/", b"!", b"|", b"#$%&*+<=>@[\\]^_`{}~", b" \t\r\x0b\x0c\n"), 1):
    _KIND[np.frombuffer(_chars, np.uint8)] = _n


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines on end, each line's weight (its bytes and one), and the number of lines of each text (one at least)."""
    data, bounds = utf8(texts)
    rows = len(bounds) - 1
    ends_of_lines = np.flatnonzero(data == 10)
    lines = np.bincount(np.searchsorted(bounds, ends_of_lines, side="right") - 1, minlength=rows) + 1
    # a line ends at its line feed or where the text ends
    order = np.argsort(np.concatenate([ends_of_lines * 2, bounds[1:] * 2 - 1]), kind="stable")
    stops = np.concatenate([ends_of_lines, bounds[1:]])[order]
    starts = np.concatenate([[0], stops[:-1] + 1])
    firsts = np.cumsum(lines) - lines
    starts[firsts] = bounds[:-1]
    size = stops - starts

    out = np.zeros((len(starts), len(FEATURES)), np.float64)
    kind = np.append(_KIND[data], 0)
    has = size > 0
    for n in range(1, 8):
        running = np.concatenate([[0], np.cumsum(kind[:-1] == n)])
        out[:, n] = running[stops] - running[starts]
    words = out[:, 7] + 1
    out[:, 1:8] *= SHARE / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size) / 10
    out[:, 8] = np.minimum(size / words / 10, 5) * has

    space = kind[:-1] == 7
    word_start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    inner = bounds[1:-1]
    word_start = np.union1d(word_start, inner[(inner < len(data))][~space[inner[inner < len(data)]]]) if len(data) else word_start
    following = np.flatnonzero(space)
    at = np.searchsorted(following, word_start)
    word_stop = np.append(following, len(data))[at] if len(word_start) else word_start
    word_stop = np.minimum(word_stop, bounds[np.searchsorted(bounds, word_start, side="right")]) if len(word_start) else word_stop
    code = piece_hashes(data, word_start, word_stop)[0]
    line = np.searchsorted(starts, word_start, side="right") - 1
    same = np.concatenate([[False], (code[1:] == code[:-1]) & (line[1:] == line[:-1])]) if len(code) else np.zeros(0, bool)
    # empty lines share a start with the line after them, which owns the word
    count = np.bincount(line, minlength=len(starts))
    out[:, 9] = np.bincount(line, weights=same, minlength=len(starts)) * SHARE / np.maximum(count, 1)

    document = np.repeat(np.arange(rows), lines)
    body = mix(piece_hashes(data, starts, stops)[0] ^ mix(document.astype(np.uint64)))
    out[:, 10] = size > 20
    out[np.unique(body, return_index=True)[1], 10] = 0
    out[firsts, 11] = 1
    out[firsts + lines - 1, 12] = 1
    out[:, 13] = 1
    return out, (size + 1).astype(np.float64), lines


def with_neighbours(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    before, after = np.roll(features, 1, axis=0), np.roll(features, -1, axis=0)
    firsts = np.cumsum(lines) - lines
    before[firsts] = 0
    after[firsts + lines - 1] = 0
    return np.concatenate([features, before, after], axis=1)


def _unary(features: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``with_neighbours(features, lines) @ weights`` without writing the neighbours out."""
    own, before, after = (features @ w for w in weights.reshape(3, -1))
    firsts = np.cumsum(lines) - lines
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[firsts] = 0
    after[firsts + lines - 1] = 0
    return own + before + after


def marginals(unary: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of every line, and the expected number of each transition. ``unary`` is a line's log-odds of bad.

    Chains are cut into blocks of about the root of the longest chain's size. What a block does to a message is the
    product of its 2 x 2 matrices, so messages first hop from block to block, and then all blocks are
    gone through side by side: a chain of n lines takes some steps of the root of n, with no approximation.
    """
    longest = int(lines.max(initial=0))
    if not longest:
        return np.zeros(0), np.zeros((2, 2))
    size = longest if longest <= 256 else int(longest**0.5) + 1
    step = np.exp(transition)
    weight = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], axis=1)
    blocks = -(-lines // size)
    chain, nth = np.repeat(np.arange(len(lines)), blocks), runs(blocks)
    start = (np.cumsum(lines) - lines)[chain] + nth * size
    length = np.minimum(lines[chain] - nth * size, size)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(size), side="left")  # blocks with more than t lines
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)
    into, behind = np.full((len(start), 2), 0.5), np.full((len(start), 2), 0.5)  # messages into a block from before and from behind it
    most = int(blocks.max())
    if most > 1:
        product = np.tile(np.eye(2), (len(start), 1, 1))
        for t in range(size):
            own = order[: active[t]]
            now = product[own] * weight[start[own] + t][:, None, :] if t == 0 else (product[own] @ step) * weight[start[own] + t][:, None, :]
            product[own] = now / now.sum(axis=(1, 2), keepdims=True)
        heads = np.cumsum(blocks) - blocks
        for n in range(1, most):
            at = heads[blocks > n] + n
            message = (into[at - 1][:, None, :] @ product[at - 1])[:, 0]
            into[at] = norm(message @ step)
        for n in range(most - 1, 0, -1):
            at = heads[blocks > n] + n
            message = (product[at] @ behind[at][:, :, None])[:, :, 0]
            behind[at - 1] = norm(message @ step.T)
    alpha, beta = np.empty_like(weight), np.empty_like(weight)
    now = into[order]
    for t in range(size):
        now = now[: active[t]]
        at = start[order[: active[t]]] + t
        now = norm((now if t == 0 else now @ step) * weight[at])
        alpha[at] = now
    for t in range(size - 1, -1, -1):
        at = start[order[: active[t]]] + t
        ends = length[order[: active[t]]] == t + 1
        beta[at[ends]] = behind[order[: active[t]][ends]]
        inner = at[~ends]
        beta[inner] = norm((weight[inner + 1] * beta[inner + 1]) @ step.T)
    later = np.ones(len(unary), bool)
    later[np.cumsum(lines) - lines] = False
    later = np.flatnonzero(later)
    tail = weight[later] * beta[later]
    total = np.einsum("ni,ij,nj->n", alpha[later - 1], step, tail)
    expected = step * ((alpha[later - 1] / total[:, None]).T @ tail)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), expected


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float

    def values(self, unary: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text's length-weighted share of good lines, and P(bad) of every line, from each line's log-odds of bad."""
        bad, _ = marginals(unary, self.transition, lines)
        firsts = np.cumsum(lines) - lines
        share = np.add.reduceat(weight * (1 - bad), firsts) / np.add.reduceat(weight, firsts) if len(lines) else np.zeros(0)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share)), bad

    def scores(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * value + self.offset)))


def _ascend(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for n in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return x


def fit(inputs: np.ndarray, weight: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = 300) -> LineModel:
    """A model whose lines take their document's label. Without documents every score is one half."""
    width = inputs.shape[1]
    if not len(lines):
        return LineModel(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)
    bad = np.repeat(1.0 - good, lines)
    seen = np.array([[((lines - 1) * good).sum(), 0], [0, ((lines - 1) * (1 - good)).sum()]])

    def gradient(x: np.ndarray) -> np.ndarray:
        p, expected = marginals(inputs @ x[:width], x[width:].reshape(2, 2), lines)
        g = np.concatenate([inputs.T @ (bad - p), (seen - expected).ravel()]) / len(bad)
        return g - 1e-5 * x

    found = _ascend(gradient, np.zeros(width + 4), rounds, 0.1)
    model = LineModel(found[:width], found[width:].reshape(2, 2), 1.0, 0.0)
    value, _ = model.values(inputs @ model.weights, weight, lines)

    def curve(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(x[0] * value + x[1])))
        return np.array([((good - p) * value).mean(), (good - p).mean()]) - 1e-4 * x

    slope, offset = _ascend(curve, np.array([1.0, 0.0]), 2 * rounds, 0.05)
    return LineModel(model.weights, model.transition, float(slope), float(offset))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by five. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 4000, train_blocks: int = 4000
) -> LineModel:
    """Fit on labelled documents that are not held out: on ``train_docs`` of them at most, those whose ids hash lowest.

    Their lines are cut into blocks of ``BLOCK_LINES``, each a chain of its own whose features are those of the whole
    text, and ``train_blocks`` of these at most reach the driver, again those that hash lowest; so neither many nor
    very long documents make the fit larger. An id that labels contradict counts as good; ids and labels that
    are null are left out; rows that repeat an id train with its label each.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(train_docs)  # a bounded side: ids and labels
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    rows = rows.select(F.xxhash64(id_col, "text").alias("text_hash"), "text", F.col("__label").cast("int").alias("label"))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            values, weight, lines = line_features(batch["text"])
            inputs = with_neighbours(values, lines).astype(np.float32)
            blocks = -(-lines // BLOCK_LINES)
            row = np.repeat(np.arange(len(lines)), blocks)
            size = np.minimum(lines[row] - runs(blocks) * BLOCK_LINES, BLOCK_LINES)
            stops = np.cumsum(size).tolist()
            pieces = [(inputs[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip([0, *stops], stops)]
            at = pa.array(row)
            columns = [batch["text_hash"].take(at), pa.array(runs(blocks)), batch["label"].take(at), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_hash", "block", "label", "inputs", "weight"])

    found = rows.mapInArrow(features, "text_hash long, block long, label int, inputs binary, weight binary")
    found = found.orderBy(F.xxhash64("text_hash", "block"), "text_hash", "block").limit(train_blocks).select("label", "inputs", "weight").collect()
    inputs = np.frombuffer(b"".join(bytes(r["inputs"]) for r in found), np.float32).reshape(-1, 3 * len(FEATURES))
    lines = np.array([len(r["weight"]) // 8 for r in found], np.int64)
    return fit(inputs.astype(np.float64), np.frombuffer(b"".join(bytes(r["weight"]) for r in found), np.float64), lines, np.array([float(r["label"] == 1) for r in found]))


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """``id_col``, held_out, score and predicted of every row, or all columns of ``docs`` and these three with ``keep``.

    A null or empty text is one empty line. Repeated rows are scored alike; an empty table gives no
    rows. Labels, languages, sources and ids are no inputs. With ``keep``, columns of ``docs``
    that have the new names give way to them.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        for batch in text_slices(batches, "__text", SLICE):
            features, weight, lines = line_features(batch["__text"])
            values = model.values(_unary(features, lines, model.weights), weight, lines)[0]
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names) if name != "__text"), pa.array(model.scores(values))], names=names)

    new = ("held_out", "score", "predicted")
    columns = [c for c in docs.columns if c not in new] if keep else [id_col]
    names = [*columns, "score"]
    rows = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    found = rows.mapInArrow(score, kinds)
    return found.select(*columns, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
