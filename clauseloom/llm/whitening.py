"""Whitening of vectors by a tall and skinny QR decomposition.

Rows are centred by exact integer sums. Each partition folds its rows into one triangular factor, the
factors are merged in a tree, and the singular values of the last one say how to whiten. The covariance
of the vectors is never formed, so no digits are lost by squaring.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged, written

#: Entries of a vector times this, rounded down, are what is whitened.
SCALE = 256
#: Entries beyond this in absolute value have no exact integer in double precision.
LARGEST = float(1 << 53)
#: Triangular factors that are merged at a time.
FAN = 8
#: Entries of rows that one step of a decomposition or projection holds.
STEP = 1 << 20
_WIDTHS = (1, 2, 4, 8)
_LONG = (1 << 63) - 1


def grid_points(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of vector: which rows are usable, and their integer entries."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.floor(flat * SCALE)
        wrong = np.concatenate([[0], np.cumsum(~(np.abs(cells) <= LARGEST))])
    stops = np.cumsum(sizes)
    usable = (sizes > 0) & (wrong[stops] == wrong[stops - sizes])
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        yield rows, cells[(stops[rows] - size)[:, None] + np.arange(size)].astype(np.int64)


def packed(points: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest integers that hold all its entries; like rows are alike."""
    low, high = points.min(axis=1), points.max(axis=1)
    out: list[bytes] = [b""] * len(points)
    left = np.ones(len(points), bool)
    for width in _WIDTHS:
        info = np.iinfo(f"<i{width}")
        fits = left & (low >= info.min) & (high <= info.max)
        rows = np.flatnonzero(fits)
        for n, row in zip(rows.tolist(), points[rows].astype(f"<i{width}")):
            out[n] = row.tobytes()
        left &= ~fits
    return out


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of size and x as matrices of integers of one size each, ``STEP`` entries at a time, about."""
    for batch in batches:
        sizes = np.asarray(batch["size"], np.int64)
        lengths = np.asarray(pc.binary_length(batch["x"]), np.int64)
        for size, length in {*zip(sizes.tolist(), lengths.tolist())}:
            rows = np.flatnonzero((sizes == size) & (lengths == length))
            step = max(1, STEP // size)
            for at in range(0, len(rows), step):
                found = batch["x"].take(pa.array(rows[at : at + step])).to_pylist()
                yield size, np.frombuffer(b"".join(found), f"<i{length // size}").reshape(len(found), size).astype(np.int64)


def total(points: np.ndarray) -> np.ndarray:
    """Exact sum of each column, as Python integers."""
    if int(np.abs(points).max(initial=0)) * len(points) < _LONG:
        return points.sum(axis=0).astype(object)
    return points.astype(object).sum(axis=0)


def deviations(points: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` of all entries, exact: 64-bit integers where they suffice, else Python's."""
    most = int(np.abs(points).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < _LONG:
        return points * n - np.array(sums, np.int64)
    return points.astype(object) * n - np.array(sums, object)


def squares(apart: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; none where 64 bits do not hold it."""
    about = (apart.astype(np.float64) ** 2).sum(axis=1)
    sure = (about < _LONG * (1 - 1e-9)) & (apart.dtype != object)
    # what wraps around on the way is right again where the sum fits
    out: list[int | None] = (apart * apart).sum(axis=1).tolist()
    for n in np.flatnonzero(~sure).tolist():
        exact = sum(int(x) ** 2 for x in apart[n]) if about[n] < _LONG * (1 + 1e-9) else _LONG + 1
        out[n] = exact if exact <= _LONG else None
    return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows; as many rows as columns at most."""
    return np.linalg.qr(rows, mode="r")


@dataclass(frozen=True)
class Whitening:
    """How vectors of one size are whitened."""

    n: int
    sums: list[int]
    axes: np.ndarray  # columns: directions over the root of their eigenvalues; NaN where it is zero
    explained: np.ndarray
    error: float | None = None

    def centred(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - S``, exact, and ``x - S / n`` in double precision."""
        apart = deviations(points, self.n, self.sums)
        return apart, apart.astype(np.float64) / self.n


def _axes(factor: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    _, values, right = np.linalg.svd(factor, full_matrices=False)
    size = factor.shape[1]
    none = values <= values.max(initial=0) * max(n, size) * np.finfo(float).eps
    kept = min(components, size)
    values, right = np.concatenate([np.where(none, 0, values), np.zeros(size)])[:size], np.concatenate([right, np.zeros((size, size))])[:size]
    # of both signs the one whose largest entry is positive
    at = np.abs(right).argmax(axis=1)
    right = right * np.where(right[np.arange(size), at] < 0, -1.0, 1.0)[:, None]
    squared = values**2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (right[:kept] / np.sqrt(squared[:kept] / n)[:, None]).T * np.where(squared[:kept] > 0, 1, np.nan), squared[:kept] / squared.sum()


def fit_whitening(points: DataFrame, components: int) -> dict[int, Whitening]:
    """For each size of vector how it is whitened. ``points`` are distinct (size, x), read three times."""
    spark = points.sparkSession

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for size, x in unpacked(batches):
            count, have = sums.get(size, (0, 0))
            sums[size] = (count + len(x), have + total(x))
        for size, (count, have) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([count] * size, pa.int64()), pa.array(list(map(Decimal, have)), pa.decimal128(38, 0))], names=["size", "i", "n", "s"]
            )

    rows = points.mapInArrow(add, "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums: dict[int, list] = {}
    counts = {r["size"]: r["n"] for r in rows}
    for r in sorted(rows, key=lambda r: (r["size"], r["i"])):
        sums.setdefault(r["size"], []).append(int(r["s"]))
    plain = {size: Whitening(counts[size], sums[size], np.zeros((0, 0)), np.zeros(0)) for size in sums}

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, np.ndarray] = {}
        for size, x in unpacked(batches):
            own = plain[size].centred(x)[1]
            factors[size] = triangle(np.concatenate([factors[size], own]) if size in factors else own)
        part = TaskContext.get().partitionId()
        for size, factor in factors.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([part], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["size", "part", "factor"])

    def merge(table: pa.Table) -> pa.Table:
        order = table.sort_by("part")
        size = order["size"][0].as_py()
        factor = triangle(np.frombuffer(b"".join(order["factor"].to_pylist()), np.float64).reshape(-1, size))
        return pa.table([order["size"][:1], pc.divide(order["part"][:1], FAN), pa.array([factor.tobytes()], pa.binary())], names=["size", "part", "factor"])

    level, path = written(points.mapInArrow(fold, "size int, part long, factor binary"), "factors")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        done = path
        level, path = written(level.groupBy("size", F.floor(F.col("part") / FAN).alias("__next")).applyInArrow(merge, "size int, part long, factor binary"), "factors")
        discard(spark, done)
    found = {}
    for r in level.collect():  # one factor for each size
        size = r["size"]
        axes, explained = _axes(np.frombuffer(r["factor"], np.float64).reshape(-1, size), counts[size], components)
        found[size] = Whitening(counts[size], sums[size], axes, explained)
    discard(spark, path)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, np.ndarray] = {}
        for size, x in unpacked(batches):
            own = found[size].centred(x)[1] @ found[size].axes
            own = np.concatenate([np.ones((len(own), 1)), own], axis=1)
            both[size] = both.get(size, 0) + own.T @ own
        for size, m in both.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["size", "i", "j", "x"])

    cells = points.mapInArrow(moments, "size int, i long, j long, x double").groupBy("size", "i", "j").agg(F.sum("x").alias("x")).collect()
    for size, own in found.items():
        m = np.zeros((own.axes.shape[1] + 1,) * 2)
        for r in cells:
            if r["size"] == size:
                m[r["i"], r["j"]] = r["x"]
        mean = m[0, 1:] / own.n
        apart = np.abs(m[1:, 1:] / own.n - np.outer(mean, mean) - np.eye(len(mean)))
        left = apart[~np.isnan(apart)]
        found[size] = Whitening(own.n, own.sums, own.axes, own.explained, float(left.max()) if len(left) else None)
    return found


def whiten_vectors(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable row of ``vectors`` and each of its first ``components`` directions: ``id_col``, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c counts as ``floor(256 * c)``; n distinct such vectors with sums S are the fit list. deviation is the sum of squares
    of ``n * x - S``, exact (null beyond 64 bits); whitened is ``x - S / n`` along the component over the root of its eigenvalue;
    explained is the eigenvalue's share; identity_error is the largest absolute entry of the covariance of whitened over
    the fit list less the identity, one value for all.

    Rows whose vector is null or empty, or holds null or non-finite entries or such as have no exact 64-bit integer (2**45 and more)
    give no rows. Rows that repeat an id or are null in it are rows of their own; equal vectors count once in the fit. Vectors of each size are
    whitened by themselves, n and identity_error included. A vector of fewer entries than ``components`` has as many
    components. Directions without variance have null whitened, and with no variance at all null explained; identity_error leaves them out.
    An empty table gives no rows. Other columns are not read.

    Sums, factors of ``size * size`` and ``components * components`` numbers reach the driver, whatever the number of rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in grid_points(batch["vector"]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(packed(x), pa.binary())], names=["size", "x"])

    points = staged(chosen.select("vector").mapInArrow(encode, "size int, x binary").distinct(), "points")
    models = fit_whitening(points, components)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in grid_points(batch["vector"]):
                own = models[x.shape[1]]
                width = own.axes.shape[1]
                for at in range(0, len(x), max(1, STEP // x.shape[1])):
                    part = slice(at, at + max(1, STEP // x.shape[1]))
                    apart, centred = own.centred(x[part])
                    count, each = len(apart), np.repeat(np.arange(len(apart)), width)
                    values = centred @ own.axes
                    columns = [
                        batch["id"].take(pa.array(rows[part][each])),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * width, own.n, np.int64)),
                        pa.array(squares(apart), pa.int64()).take(pa.array(each)),
                        pa.array(values.ravel(), from_pandas=True),
                        pa.array(np.tile(own.explained, count), from_pandas=True),
                        pa.array([own.error] * (count * width), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = chosen.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.withColumnRenamed("id", id_col)
