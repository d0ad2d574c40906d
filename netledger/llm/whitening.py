"""Embedding whitening: principal components by FEAST contour integration over a covariance that Spark gathers.

Every entry c of a vector becomes the integer floor(256 c). The fit list is each distinct integer vector once, so copies weigh
nothing. Spark makes the list (one shuffle, copies meet before it), then the sums and the covariance, a partial matrix per task;
the driver sees dimensions x dimensions numbers only. There the leading eigenpairs come from FEAST: inertia counts (signs of
the pivots of V - s) bracket the interval that holds them, a quadrature along a circle around it solves complex shifted systems and
so projects a few random directions onto its eigenvectors, Rayleigh-Ritz takes the pairs out, and the inertia counts at both ends
tell that none is missed (else the subspace grows).

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; of vectors of different lengths the
shorter ones are filled with zeros; entries beyond 64 bits stop at the largest long; rows that share an id, or have none, give
their own rows each; an empty table gives no rows; with fewer than four dimensions there are as many components; where an eigenvalue is 0
(one vector, or dependent dimensions) whitened is null, and explained is null if all are; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.storage import stage

COMPONENTS = 4
#: Entries are compared and averaged as multiples of 1 / SCALE.
SCALE = 256
#: Points of the quadrature on a half circle.
NODES = 8
OUTPUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_SAFE = 2.0**62
_LONG = (1 << 63) - 1


# -- eigenpairs of an interval ------------------------------------------------------------------------------------------------

def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above shift: positive pivots of LDL' with symmetric 1x1 and 2x2 pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a))).argmax() if n > 1 else 0
        i, j = divmod(int(off), n)
        if n == 1 or diagonal[p] >= 0.64 * abs(a[i, j]):
            keep = np.delete(np.arange(n), p)
            if a[p, p] == 0:  # nothing but zeros is left
                return positive
            positive += a[p, p] > 0
            column = a[keep, p]
            a = a[np.ix_(keep, keep)] - np.outer(column, column) / a[p, p]
        else:
            keep = np.delete(np.arange(n), [i, j])
            block = a[np.ix_([i, j], [i, j])]
            positive += 1  # its determinant is negative: one eigenvalue on each side
            column = a[np.ix_(keep, [i, j])]
            a = a[np.ix_(keep, keep)] - column @ np.linalg.solve(block, column.T)
    return int(positive)


def _below(matrix: np.ndarray, count: int, low: float, high: float, digits: float) -> float:
    """About the count-th largest eigenvalue, from below: bisection on inertia counts. inertia(low) >= count > inertia(high)."""
    while high - low > digits:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if inertia(matrix, middle) >= count else (low, middle)
    return low


def leading_interval(matrix: np.ndarray, k: int) -> tuple[float, float, int]:
    """(low, high, m): an interval that holds the m >= k largest eigenvalues, with its ends inside gaps of the spectrum."""
    size = float(np.abs(matrix).sum(1).max())
    bottom, top = -1.01 * size, 1.01 * size
    kth = _below(matrix, k, bottom, top, 1e-13 * size)
    m = inertia(matrix, kth)
    high = _below(matrix, 1, kth, top, 1e-3 * size) + 2e-3 * size
    if m == len(matrix):
        return kth - 1e-2 * size, high, m
    after = _below(matrix, m + 1, bottom, kth, 1e-4 * max(size - abs(kth), 1e-9 * size))
    low = (kth + after) / 2
    return low, high, inertia(matrix, low)


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs with eigenvalues in [low, high], largest first; count of them are known to be there."""
    n = len(matrix)
    x, weight = np.polynomial.legendre.leggauss(NODES)
    angle = -np.pi / 2 * (x - 1)
    radius, centre = (high - low) / 2, (high + low) / 2
    turn = radius * np.exp(1j * angle)
    solvers = [np.linalg.inv((centre + t) * np.eye(n) - matrix) for t in turn]  # one factorisation per point and matrix
    size = min(n, 2 * count + 8)
    scale = np.abs(matrix).sum(1).max()
    while True:
        y = np.random.default_rng(size).standard_normal((n, size))
        for _ in range(rounds):
            projected = sum(w / 2 * (t * (solve @ y)).real for w, t, solve in zip(weight, turn, solvers))
            q, _ = np.linalg.qr(projected)
            value, inner = np.linalg.eigh(q.T @ matrix @ q)  # Rayleigh-Ritz in the small space
            y = q @ inner
            inside = np.flatnonzero((value >= low) & (value <= high))
            rest = matrix @ y[:, inside] - y[:, inside] * value[inside]
            if len(inside) == count and np.abs(rest).max() <= 4e-15 * np.sqrt(n) * scale:
                break
        if len(inside) == count or size == n:
            order = inside[::-1]
            return value[order], y[:, order]
        size = min(n, 2 * size)  # pairs are missing: the inertia counts say so


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns, the entry of largest size positive)."""
    matrix = (matrix + matrix.T) / 2
    scale = np.abs(matrix).max() if matrix.size else 0.0
    if not scale:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    low, high, count = leading_interval(matrix / scale, k)
    value, vector = feast(matrix / scale, low, high, count)
    value, vector = value[:k] * scale, vector[:, :k]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(k)])
    return value, vector * sign


# -- gathering ----------------------------------------------------------------------------------------------------------------

def integers(vector: Column) -> Column:
    """The entries as multiples of 1 / SCALE (array of long); null where the vector is not usable."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda c: F.floor(c * SCALE)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as longs if they fit, else as Python integers."""
    largest = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < _SAFE / 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


@dataclass
class Whitening:
    """What a fit leaves: bounded by the number of dimensions."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float = 0.0

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates (NaN in components without variance)."""
        centred = (deviations / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), np.nan)


def _summed(rows: DataFrame, task, dims: int) -> np.ndarray:
    """Sum over all tasks of the symmetric dims x dims matrix that task makes of a batch of rows; parts meet in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                total += task(batch)
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    cells = rows.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((dims, dims))
    out[cells["i"], cells["j"]] = cells["s"]
    out[cells["j"], cells["i"]] = cells["s"]
    return out


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """vectors: x (array of dims longs), in any number of copies."""
    distinct = stage(vectors.distinct(), "distinct-vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            small = float(np.abs(x.astype(np.float64)).max(initial=0)) * max(len(x), 1) < _SAFE
            part = (x if small else x.astype(object)).sum(0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dims), pa.int32()), pa.array(map(str, [n, *total]), pa.string())], ["at", "s"])

    parts = distinct.mapInArrow(sums, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found = {r["at"]: int(r["s"]) for r in parts.collect()}  # one number per dimension
    n, total = found.get(-1, 0), [found.get(k, 0) for k in range(dims)]
    k = min(components, dims)
    if not n:
        return Whitening(0, total, np.zeros(k), np.eye(dims)[:, :k], [None] * k)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = (_deviations(_matrix(batch.column(0), dims), n, total) / n).astype(np.float64)
        return centred.T @ centred

    covariance = _summed(distinct, products, dims) / n
    values, basis = leading_pairs(covariance, k)
    trace = float(np.trace(covariance))
    values = np.where(values > dims * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
    model = Whitening(n, total, values, basis, [float(v) / trace if trace > 0 else None for v in values])
    kept = np.flatnonzero(values > 0)

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        w = model.project(_deviations(_matrix(batch.column(0), dims), n, total))[:, kept]
        return w.T @ w

    if len(kept):
        model.identity_error = float(np.abs(_summed(distinct, whitened, len(kept)) / n - np.eye(len(kept))).max())
    return model


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for every usable row and leading component."""
    rows = df.select(df[key].alias("key"), integers(df[vector]).alias("x")).filter("x is not null")
    dims = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), dims - F.size("x"))))
    model = fit(rows.select("x"), dims, components)
    k = min(components, dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            deviations = _deviations(_matrix(batch.column(1), dims), model.n, model.sums)
            exact = float(np.abs(deviations.astype(np.float64)).max(initial=0)) ** 2 * dims < _SAFE
            squares = ((deviations if exact else deviations.astype(object)) ** 2).sum(1)
            flat = model.project(deviations).reshape(-1)
            times = np.repeat(np.arange(batch.num_rows), k)
            many = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(times)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                pa.array(np.full(many * k, model.n, np.int64)),
                pa.array([int(s) if s <= _LONG else None for s in squares.tolist()], pa.int64()).take(pa.array(times)),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(model.explained * many, pa.float64()),
                pa.array(np.full(many * k, model.identity_error)),
            ], ["key", *OUTPUT])

    schema = f"`key` {df.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = [key, *OUTPUT]
    return rows.mapInArrow(project, schema).toDF(*names)
