"""Whitening of embeddings by shifted CholeskyQR.

Vectors are read as whole numbers x = floor(256 * c). The fit list holds each distinct x vector once; its rows, centred by the
exact sums, are the matrix A. Every pass sums the Gram matrix of A's rows after triangular solves by the factors found
so far, and its Cholesky factor is the next one:

    A = Q R_k ... R_2 R_1

The first Gram matrix is shifted, so that its factor exists however ill-conditioned A is; the passes after it bring Q to
orthonormal columns, which a single Gram matrix (whose condition is the square of A's) could not. Singular values and right
vectors of the small R = R_k ... R_1 are those of A: its principal axes and n times its variances.

Tasks send sums of as many numbers as the Gram matrix has entries; only these, added up by entry, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeforge.session import stage_table

STEP = 256
TOP = 4
#: Passes over the fit list at most; three do unless some variance is zero or almost so.
PASSES = 6
#: Q counts as orthonormal when its Gram matrix is this close to the identity.
ORTHONORMAL = 1e-13
_UNIT = np.finfo(float).eps / 2


@dataclass(frozen=True)
class Whitening:
    """Size and sums of the fit list, and its leading axes (one row each), variances and share of the whole variance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return _centre(self.n, self.sums)


def _centre(n: int, sums) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector has at least one entry and neither null nor non-finite ones."""
    c = F.col(vector)

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))

    whole = F.transform(c, lambda v: F.floor(v.cast("double") * STEP).cast("long"))
    return rows.where(c.isNotNull() & (F.size(c) > 0)).where(F.forall(c, finite)).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverses of upper triangular ``factors``, first one first."""
    for upper in factors:
        out = np.empty_like(rows)
        for j in range(len(upper)):
            out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
        rows = out
    return rows


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over batches of the fit list of a matrix that ``part`` makes of each; added up by entry in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(_matrix(batch))
                total = made if total is None else total + made
        if total is not None:
            at, entries = np.indices(total.shape).reshape(2, -1), total.reshape(-1)
            yield pa.record_batch([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(entries)], ["i", "j", "v"])

    added = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = [1 + max(r[k] for r in added) for k in ("i", "j")]
    out = np.zeros(size)
    for i, j, v in added:
        out[i, j] = v
    return out


def _exact_sums(fit: DataFrame) -> tuple[int, ...]:
    """The sum of each dimension. High and low halves are added apart, so that no partial sum overflows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = total or [0] * x.shape[1]
            total = [t + (h << 32) + k for t, h, k in zip(total, high, low, strict=True)]
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["j", "v"])

    added = fit.mapInArrow(partial, "j int, v decimal(38,0)").groupBy("j").agg(F.sum("v").alias("v")).orderBy("j").collect()
    return tuple(int(r["v"]) for r in added)


def _factors(fit: DataFrame, centre: np.ndarray, n: int) -> list[np.ndarray]:
    """Upper triangular factors R_1, R_2, ... of the centred fit list; the last may be a symmetric root where A lacks rank."""
    d = len(centre)
    factors: list[np.ndarray] = []
    least = 0.0
    for turn in range(PASSES):
        known = list(factors)

        def gram(x: np.ndarray, known: list[np.ndarray] = known) -> np.ndarray:
            q = _solved(x - centre, known)
            return q.T @ q

        g = _summed(fit, gram)
        if not np.trace(g) > 0:
            return []
        if turn and np.abs(g - np.eye(d)).max() <= ORTHONORMAL:
            break
        values, vectors = np.linalg.eigh(g)
        shift = 11 * (n * d + d * (d + 1)) * _UNIT * np.trace(g)
        if turn and values[0] > np.sqrt(_UNIT):
            factors.append(np.linalg.cholesky(g).T)
        elif turn and (turn == PASSES - 1 or values[0] <= 4 * max(least, 0.0)):
            # Shifting again lifts no direction any more: those left have no variance.
            factors.append((vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T)
            break
        else:
            factors.append(np.linalg.cholesky(g + min(shift, np.trace(g)) * np.eye(d)).T)
            least = values[0] if turn else 0.0
    return factors


def fit_whitening(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> Whitening | None:
    """Axes of the distinct x vectors of ``rows``, by falling variance, at most ``top``; each axis's largest entry is positive.

    Rows whose vector is null, empty or holds null or non-finite entries don't count, nor do vectors of another length than most
    distinct ones have (ties: the longer). Entries beyond a long's range count as its ends. Axes without variance are left out.
    None if no vector is left.
    """
    fit = stage_table(whole_vectors(rows, vec_id, vector).select("x").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths
    fit = fit.where(F.size("x") == d)
    sums = _exact_sums(fit)
    centre = _centre(n, sums)
    factors = _factors(fit, centre, n)
    whole = np.eye(d)
    for factor in factors:
        whole = factor @ whole
    _, sizes, axes = np.linalg.svd(whole)
    variances = sizes**2 / n if factors else np.zeros(d)
    kept = np.flatnonzero(sizes > 16 * d * _UNIT * sizes[0])[:top] if factors else np.zeros(0, int)
    axes = axes[kept]
    if len(kept):
        axes = axes * np.sign(axes[np.arange(len(kept)), np.abs(axes).argmax(axis=1)])[:, None]

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - centre) @ axes.T / np.sqrt(variances[kept])
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = 0.0
    if len(kept):
        added = _summed(fit, moments) / n
        mean = added[-1]
        error = float(np.abs(added[:-1] - np.outer(mean, mean) - np.eye(len(kept))).max())
    return Whitening(n, sums, axes, variances[kept], variances[kept] / variances.sum() if len(kept) else np.zeros(0), error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) squared, exact; None beyond a long."""
    most = n * float(np.abs(x.astype(float)).max(initial=0.0)) + max(abs(s) for s in sums)
    if most**2 * x.shape[1] < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in found]


def whiten(rows: DataFrame, fitted: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened) of the rows with a usable vector of the fitted length: deviation is the exact sum over dimensions
    of (n * x - S) squared (null beyond a long), whitened the centred x on each axis over its standard deviation.

    Equal rows and null ids come back as they are; columns besides the two are not read; an empty table, or none fitted, gives no rows.
    """
    schema = "vec_id long, deviation long, whitened array<double>"
    whole = whole_vectors(rows, vec_id, vector)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, centre, axes, spread = fitted.n, fitted.sums, fitted.centre, fitted.axes, np.sqrt(fitted.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            made = (x - centre) @ axes.T / spread
            ends = pa.array(np.arange(len(x) + 1) * len(spread), pa.int32())
            whitened = pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))
            yield pa.record_batch([batch.column("vec_id"), pa.array(_deviations(x, n, sums), pa.int64()), whitened], ["vec_id", "deviation", "whitened"])

    return whole.where(F.size("x") == len(sums)).mapInArrow(project, schema)
