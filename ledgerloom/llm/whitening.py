"""Operator 12, whitening of embeddings by mixed-precision refinement of the covariance's eigenvectors.

The entries become whole numbers x. The covariance of the distinct x vectors is exact: tasks centre the vectors at whole numbers next
to the mean, multiply in floating point where every sum is a whole number below 2 ** 53, and add up whole numbers; what the mean has
beyond the whole numbers is taken off exactly. Its eigenvectors are found in single precision, then corrected by the iteration
of Ogita and Aishima, which is matrix products only, in the widest floating-point numbers that numpy has. Eigenvalues closer to each other
than the iteration can tell are a cluster: the small eigenproblem of the cluster, shifted to its middle, is solved by itself, and the
iteration goes on with its vectors. Only matrices of width x width reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

SCALE = 256
COMPONENTS = 4
#: Entries this far from the mean are read; beyond, products of two halves would not be exact.
FARTHEST = 1 << 31
_HALF = 1 << 16
#: Vectors multiplied at once: 2 ** 30 for a product of halves, times so many, is below 2 ** 53.
BLOCK = 1 << 20
#: Bytes of partial sums that the driver gets at most, whatever the number of tasks.
TO_DRIVER = 64 << 20


class Fit(NamedTuple):
    """n distinct vectors; whole centre and n times what the mean has beyond it; eigenvalues, vectors (a column each) and their sum."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of each entry, as double, in a long; null for a vector that is null or holds null or non-finite entries."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# -- exact sums --------------------------------------------------------------------------------


def _limbs(sums: np.ndarray) -> np.ndarray:
    """Whole numbers as (low 32 bits, the rest), so that very many of them can be added."""
    return np.stack([sums & 0xFFFFFFFF, sums >> 32])


def _added(parts: DataFrame, length: int) -> tuple[int, list[int]]:
    """(n, the sums) over rows of n and limbs, added in a few streams of bounded memory and then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, length), dtype=np.int64)
        for batch in batches:
            for k, blob in zip(batch.column("n").to_pylist(), batch.column("limbs"), strict=True):
                n += k
                total += np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(2, length)
                total[1] += total[0] >> 32
                total[0] &= 0xFFFFFFFF
        yield pa.RecordBatch.from_pydict({"n": [n], "limbs": [total.tobytes()]})

    lanes = max(1, min(16, TO_DRIVER // (16 * length)))
    rows = parts.repartition(lanes).mapInArrow(add, "n long, limbs binary").collect()
    total = [0] * length
    for r in rows:
        low, high = np.frombuffer(r["limbs"], dtype=np.int64).reshape(2, length).tolist()
        total = [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
    return sum(r["n"] for r in rows), total


def _column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            total += np.stack([(x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"n": [n], "limbs": [total.tobytes()]})

    return _added(fit.mapInArrow(run, "n long, limbs binary"), width)


def products(y: np.ndarray) -> np.ndarray:
    """The sums of the products of all pairs of columns (upper triangle, row by row) in three rows: of high halves, of high and low
    ones, of low ones. Exact."""
    if len(y) and max(int(y.max()), -int(y.min())) >= FARTHEST:
        raise OverflowError(f"an entry is farther than {FARTHEST // SCALE} from the mean")
    upper = np.triu_indices(y.shape[1])
    out = np.zeros((3, len(upper[0])), dtype=np.int64)
    for i in range(0, len(y), BLOCK):
        part = y[i : i + BLOCK]
        high = (part + _HALF // 2) // _HALF
        low = (part - high * _HALF).astype(np.float64)
        out[2] += (low.T @ low).astype(np.int64)[upper]
        if high.any():
            high = high.astype(np.float64)
            out[0] += (high.T @ high).astype(np.int64)[upper]
            mixed = (high.T @ low).astype(np.int64)
            out[1] += (mixed + mixed.T)[upper]
    return out


def _product_sums(fit: DataFrame, centre: np.ndarray) -> list[int]:
    width = len(centre)
    pairs = width * (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * pairs), dtype=np.int64)
        for batch in batches:
            total += _limbs(products(_matrix(batch, width) - centre).ravel())
            total[1] += total[0] >> 32
            total[0] &= 0xFFFFFFFF
        yield pa.RecordBatch.from_pydict({"n": [0], "limbs": [total.tobytes()]})
        give_back()

    _, sums = _added(fit.mapInArrow(run, "n long, limbs binary"), 3 * pairs)
    return [(a << 32) + (b << 16) + c for a, b, c in zip(sums[:pairs], sums[pairs : 2 * pairs], sums[2 * pairs :], strict=True)]


# -- eigenvectors ------------------------------------------------------------------------------


def wide(numerators: list[int], denominator: int, width: int) -> np.ndarray:
    """The symmetric matrix of these fractions (upper triangle, row by row) in the widest floating-point numbers."""
    out = np.zeros((width, width), dtype=np.longdouble)
    upper = np.triu_indices(width)
    near = [v / denominator for v in numerators]
    left = [float((v - Fraction(a) * denominator) / denominator) for v, a in zip(numerators, near, strict=True)]
    out[upper] = np.array(near, dtype=np.longdouble) + np.array(left, dtype=np.longdouble)
    return np.triu(out) + np.triu(out, 1).T


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Runs of eigenvalues of which neighbours are no farther from each other."""
    order = np.argsort(values)
    return [c for c in np.split(order, np.flatnonzero(np.diff(values[order]) > apart) + 1) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray, *, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric matrix a, from approximate eigenvectors x, in a's precision."""
    unit, best, size = np.eye(len(a), dtype=a.dtype), math.inf, float(np.linalg.norm(a.astype(np.float64)))
    x = x.astype(a.dtype)
    # Closer than the products' rounding, eigenvalues are equal.
    equal = 16 * len(a) * size * float(np.finfo(a.dtype).eps)
    for _ in range(rounds):
        ax = a @ x
        lacks, rotated = unit - x.T @ x, x.T @ ax
        values = np.diag(rotated) / (1 - np.diag(lacks))
        off = float(np.abs(rotated - np.diag(np.diag(rotated))).sum(axis=1).max())
        apart = max(equal, 2 * (off + size * float(np.abs(lacks).sum(axis=1).max())))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        step = np.where(far, (rotated + values[None, :] * lacks) / np.where(far, gap, 1), lacks / 2)
        x = x + x @ step
        for c in _clusters(values, apart):
            # Shifted to the cluster's middle, its small differences have all digits of double precision.
            own = x[:, c]
            shift = values[c].mean()
            inner = own.T @ (a @ own) - shift * (own.T @ own)
            top = float(np.abs(inner).max())
            if top > 0:
                _, turn = np.linalg.eigh((inner / top).astype(np.float64))
                # One step of Newton and Schulz makes the turn orthogonal to the wider precision.
                turn = turn.astype(a.dtype)
                turn = turn + turn @ (np.eye(len(c), dtype=a.dtype) - turn.T @ turn) / 2
                x[:, c] = own @ turn
        change = float(np.abs(step).max()) + off / size
        if change >= best / 2 and best < 1e-13:
            break
        best = min(best, change)
    ax = a @ x
    return np.diag(x.T @ ax) / np.diag(x.T @ x), x / np.sqrt((x * x).sum(axis=0))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, eigenvectors as columns) of a symmetric matrix in its own precision, by way of single precision."""
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, x = np.linalg.eigh(a.astype(np.float32))
    values, x = refined(a, x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def fitted(fit: DataFrame, width: int) -> Fit:
    """Mean and principal axes of a table of distinct vectors x."""
    n, sums = _column_sums(fit, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    whole = np.array(centre, dtype=np.int64)
    i, j = (k.tolist() for k in np.triu_indices(width))
    exact = [n * q - rest[a] * rest[b] for q, a, b in zip(_product_sums(fit, whole), i, j, strict=True)]
    values, vectors = eigen(wide(exact, n * n, width))
    return Fit(n, whole, rest, values, vectors, sum(v for v, a, b in zip(exact, i, j, strict=True) if a == b) / (n * n))


# -- rows --------------------------------------------------------------------------------------


def _projected(x: np.ndarray, f: Fit, axes: np.ndarray) -> np.ndarray:
    return ((x - f.centre) - np.array([r / f.n for r in f.rest])) @ axes


def _deviations(x: np.ndarray, f: Fit) -> pa.Array:
    """The sum of (n * x - S) ** 2 of each row, exact."""
    y = x - f.centre
    most = max(map(abs, f.rest), default=0) + f.n * max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        t = y * f.n - np.array(f.rest, dtype=np.int64)
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    t = y.astype(object) * f.n - np.array(f.rest, dtype=object)
    return pa.array([str(v) for v in (t * t).sum(axis=1)]).cast(pa.decimal128(38, 0))


def identity_error(fit: DataFrame, f: Fit, axes: np.ndarray) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, at most; null without a component."""
    k, width = axes.shape[1], len(f.centre)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for batch in batches:
            w = _projected(_matrix(batch, width), f, axes)
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "v": total})

    sums = dict(fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    every = np.array([sums[i] for i in range(k * k + k)]) / f.n
    mean = every[k * k :]
    return float(np.abs(every[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another length than most have (of equally
    frequent lengths the greater counts). Equal vectors count once in the fit and have rows of their own in the result, as have rows of one id or
    none. Where all vectors of the fit agree along a component, its variance is 0: `whitened` is null there, and identity_error, null if no component has variance,
    leaves it out. deviation is a whole number of 38 digits at most. Entries farther than 2 ** 23 from the mean raise an error. An
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).filter("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    rows = rows.filter(F.size("x") == width)
    fit = cut(rows.select("x").distinct())
    f = fitted(fit, width)
    k = min(components, width)
    varied = f.values[:k] > f.trace * width * 2.0**-52
    axes = f.vectors[:, :k][:, varied] / np.sqrt(f.values[:k][varied])
    explained = np.where(varied, f.values[:k] / f.trace if f.trace else 0.0, 0.0)
    error = identity_error(fit, f, axes)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            each = np.repeat(np.arange(len(x)), k)
            values = np.zeros((len(x), k))
            values[:, varied] = _projected(x, f, axes)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), f.n)),
                _deviations(x, f).take(pa.array(each)),
                pa.array(values.ravel(), mask=np.tile(~varied, len(x))),
                pa.array(np.tile(explained, len(x))),
                pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
