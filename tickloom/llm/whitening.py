"""Embedding whitening by QDWH spectral divide-and-conquer.

Pass 1 adds up the rows and the entries of each dimension, pass 2 the products of the centred
entries; both add one small array for each task in a tree. The covariance has the vectors' dimension on
both sides, whatever the number of rows, so its decomposition is the driver's: the polar
factor of the covariance less a shift (QR-based dynamically weighted Halley steps, Cholesky-free)
gives the projector on the components above the shift; bases of its range and
of the complement cut the covariance in two smaller ones, and so on until one component, or a
multiple of the identity, is left. The components, scaled, are broadcast (dimension times
components doubles) and every row is projected in its own task.

Defined cases: rows whose vector is null, empty, or holds a null or a number that is not finite take no part; ids
may be null, repeated rows count each; an empty table gives an empty result. Vectors of different lengths raise. A
component whose eigenvalue is zero up to rounding has no scale: its whitened values are null, and the identity check
leaves it out. Equal eigenvalues give some orthonormal basis of their space. Other columns are ignored. Vectors may be of long (centred
without rounding before the division) or of double; ``MAX_DIMENSION`` bounds what driver and broadcast hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.vectors import matrix, reduce_tasks, usable
from tickloom.session import ship_module

ship_module(__name__)

#: Longest vectors: a covariance of 2048 x 2048 doubles is 34 MB.
MAX_DIMENSION = 2048
_EPS = np.finfo(float).eps
#: Places of the shift to try, in mean deviations of the spectrum from its mean.
_SHIFTS = (0.0, 0.31, -0.31, 0.53, -0.53, 0.11, -0.11, 0.83, -0.83)


# --- the decomposition ------------------------------------------------------------------


def polar(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix; for each eigenvalue its sign."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.abs(a).sum(axis=0).max()
    low = _EPS / n
    for _ in range(steps):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / (low2 * low2))
        root = np.sqrt(1 + d)
        w = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low2) / (low2 * root))
        v = (w - 1) ** 2 / 4
        c = w + v - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, eye)))
        after = v / c * x + (w - v / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (w + v * low2) / (1 + c * low2))
        moved = np.linalg.norm(after - x)
        x = after
        if 1 - low < 10 * _EPS and moved < np.cbrt(_EPS):
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below some shift."""
    n = len(a)
    diagonal = np.diag(a)
    middle, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(n)) / np.sqrt(n)
    median = np.median(diagonal)
    shifts = [median] if diagonal.min() < median < diagonal.max() else []
    start = np.random.default_rng(n).standard_normal((n, n))
    for shift in [*shifts, *(middle + s * spread for s in _SHIFTS)]:
        sign = polar(a - shift * np.eye(n))
        above = int(round((np.trace(sign) + n) / 2))
        # A shift on an eigenvalue leaves a sign between -1 and 1.
        if not 0 < above < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-7 * n:
            continue
        projector = (sign + np.eye(n)) / 2
        q = start[:, :above]
        for _ in range(4):
            q, _ = np.linalg.qr(projector @ q[:, :above], mode="complete")
            if np.linalg.norm(q[:, above:].T @ a @ q[:, :above]) <= 4 * n * _EPS * np.linalg.norm(a):
                return q[:, :above], q[:, above:]
    raise ArithmeticError("no shift splits the spectrum")


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    done = 8 * _EPS * np.linalg.norm(a)

    def solve(block: np.ndarray) -> np.ndarray:
        if len(block) == 1 or np.linalg.norm(block - np.diag(np.diag(block))) <= done:
            return np.eye(len(block))
        parts = []
        for basis in _halves(block):
            inner = basis.T @ block @ basis
            parts.append(basis @ solve((inner + inner.T) / 2))
        return np.hstack(parts)

    vectors = solve((a + a.T) / 2)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)


# --- the passes ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` finds. ``sums`` are exact for vectors of long."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def scale(self, count: int) -> np.ndarray:
        """Columns to project on; not-a-number for components without extent."""
        e = self.eigenvalues[:count]
        extent = e > 16 * len(self.eigenvalues) * _EPS * max(self.eigenvalues[0], 0.0)
        return self.vectors[:, :count] / np.sqrt(np.where(extent, e, np.nan))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if x.dtype != np.int64:
        return x - sums / n
    # In whole numbers while they fit: the mean is far larger than the deviations.
    if max(int(x.max()), -int(x.min())) * n < 2**62:
        return (n * x - sums) / n
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


def _sums(parts: Iterable[np.ndarray]) -> np.ndarray | None:
    total = None
    for x in parts:
        own = np.concatenate(([len(x)], x.sum(axis=0)))
        total = own if total is None else total + own
    return total


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def _moments(parts: Iterable[np.ndarray]) -> np.ndarray | None:
    """Rows, means and centred products of a task, batch by batch."""
    total = None
    for x in parts:
        mean = x.mean(axis=0)
        own = np.concatenate(([len(x)], mean, ((x - mean).T @ (x - mean)).ravel()))
        total = own if total is None else _joined(total, own)
    return total


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(4 * len(a) - 3) - 1) / 2 + 0.5)
    n, step = a[0] + b[0], b[1:d + 1] - a[1:d + 1]
    products = a[d + 1:] + b[d + 1:] + (a[0] * b[0] / n * np.outer(step, step)).ravel()
    return np.concatenate(([n], a[1:d + 1] + step * (b[0] / n), products))


def vectors_of(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, vector: the rows that take part."""
    return rows.where(usable(F.col(vector_column))).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))


def fit(vectors: DataFrame) -> Whitening | None:
    """Sums, covariance (divisor n, centred before multiplying) and its components; None without rows."""
    only = vectors.select("vector")
    sums = reduce_tasks(only, _sums, _added, "long" if "bigint" in only.schema[0].dataType.simpleString() else "double")
    if sums is None:
        return None
    n, sums = int(sums[0]), sums[1:]
    if len(sums) > MAX_DIMENSION:
        raise ValueError(f"{len(sums)} entries a vector, {MAX_DIMENSION} at most")

    def products(parts: Iterable[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            c = _centred(x, n, sums)
            total = (c.T @ c).ravel() if total is None else total + (c.T @ c).ravel()
        return total

    covariance = reduce_tasks(only, products, _added).reshape(len(sums), -1) / n
    values, vectors_ = components(covariance)
    return Whitening(n, sums, values, vectors_, float(np.trace(covariance)))


def whiten(vectors: DataFrame, model: Whitening, count: int) -> DataFrame:
    """The rows of ``vectors`` with ``whitened``: the centred vector on the first ``count`` components, each to variance one; null
    entries where a component has no extent."""
    at, schema = vectors.columns.index("vector"), T.StructType([*vectors.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.scale(count)))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scale = shared.value
        for batch in batches:
            if batch.num_rows:
                w = _centred(matrix(batch.column(at)), n, sums) @ np.nan_to_num(scale)
                w[:, np.isnan(scale).any(axis=0)] = np.nan
                flat = pa.array(w.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=schema.names)

    return vectors.mapInArrow(project, schema)


def identity_error(whitened: DataFrame) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity; None without a component of any extent."""
    filled = whitened.select(F.filter("whitened", lambda w: w.isNotNull()).alias("w")).where(F.size("w") > 0)
    found = reduce_tasks(filled, _moments, _joined)
    if found is None:
        return None
    d = int((np.sqrt(4 * len(found) - 3) - 1) / 2 + 0.5)
    return float(np.abs(found[d + 1:].reshape(d, d) / found[0] - np.eye(d)).max())
