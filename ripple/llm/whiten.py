"""Whitening of embeddings by the leading eigenvectors of their covariance.

* *Covariance*: whole-number vectors are centred at the rounded mean before they
  are multiplied, so every partition's sums of products are exact while they
  stay below 2**53 and do not depend on how Spark deals the rows; the rest of
  the mean (at most a half) is taken off once, from the added-up matrix.
* *Eigenvectors*: the covariance (dimension squared, whatever the number of
  rows) is brought to tridiagonal form by Householder reflections; bisection on
  Sturm counts gives the leading eigenvalues; inverse iteration gives their
  vectors, each made orthogonal to the earlier ones of its cluster; the
  reflections take them back.
* *Projection*: the components go to the tasks with the function; rows are
  projected where they lie.

Rows whose vector is null or holds null or non-finite entries are dropped
(``quantized``).  The vectors of the most frequent length (ties: the longer)
are the fit list; others take no part.  Components with an eigenvalue of at most
``FLAT`` of the largest cannot be divided by their spread and are left out, so
equal vectors, or a single one, give no rows, as an empty table does.  Null ids
are kept, repeated rows count each.  Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import slices, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-12                    # of the largest eigenvalue: no spread
BLOCK = 4096                    # vectors of one matrix product


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: floor(SCALE * c) + SHIFT of each entry, for vectors whose entries are all finite."""
    finite = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).alias("vec_id"),
        F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _products(width: int, make):
    """Sums of products of make(batch) (rows by width) over a partition, as rows (i, j, s) with j >= i."""
    low = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in slices(batches, BLOCK):
            y = make(batch)
            total += y.T @ y
            seen |= len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(low[0], pa.int32()), pa.array(low[1], pa.int32()),
                                              pa.array(total[low])], names=["i", "j", "s"])

    return run


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The symmetric matrix of rows (i, j, s); width squared numbers, added up by Spark."""
    out = np.zeros((width, width))
    for i, j, s in parts.groupBy("i", "j").agg(F.sum("s")).collect():
        out[i, j] = out[j, i] = s
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors that bring the symmetric ``a`` to tridiagonal form."""
    a, n, reflections = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            p = a[k + 1:, k + 1:] @ v
            w = 2 * (p - (v @ p) * v)
            a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = a[k, k + 1] = x[0] - 2 * v[0] * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_above(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix exceed each value of ``at`` (Sturm counts)."""
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.abs(e).max(initial=0)))
    q = d[0] - at
    n = (q > 0).astype(int)
    for i in range(1, len(d)):
        q = d[i] - at - e[i - 1] ** 2 / np.where(np.abs(q) < tiny, np.copysign(tiny, q), q)
        n += q > 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    around = np.abs(np.r_[e, 0]) + np.abs(np.r_[0, e])
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    pad = 1e-14 * max(abs(low[0]), abs(high[0]))
    low, high = low - pad, high + pad
    want = np.arange(1, k + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        above = count_above(d, e, mid) >= want
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, at: float, b: np.ndarray) -> np.ndarray:
    """x of (T - at) x = b, by elimination with row exchanges."""
    n, b = len(d), b.copy()
    eps = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(float).tiny)
    u, v, w = d - at, np.r_[e, 0.0], np.zeros(n)         # three diagonals of the upper factor
    for i in range(n - 1):
        below, nxt, right = e[i], u[i + 1], v[i + 1]
        if abs(below) > abs(u[i]):
            m = u[i] / below
            u[i], v[i], w[i], u[i + 1], v[i + 1] = below, nxt, right, v[i] - m * nxt, -m * right
            b[i], b[i + 1] = b[i + 1], b[i] - m * b[i + 1]
        else:
            u[i] = u[i] or eps
            m = below / u[i]
            u[i + 1] = nxt - m * v[i]
            b[i + 1] -= m * b[i]
    x = np.zeros(n)
    for i in reversed(range(n)):
        rest = b[i] - (v[i] * x[i + 1] if i + 1 < n else 0) - (w[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / (u[i] or eps)
        if abs(x[i]) > 1e150:
            x, b = x / abs(x[i]), b / abs(x[i])
    return x


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (rows) of the tridiagonal matrix for falling ``values``, by inverse iteration.

    Values closer than 1e-3 of the norm form a cluster; a vector is made
    orthogonal to the earlier ones of its cluster after every step, and values
    that agree to rounding are moved apart a little so that their vectors differ.
    """
    norm = np.abs(values).max()
    out, start, last = np.zeros((len(values), len(d))), 0, math.inf
    random = np.random.default_rng(0)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = value if k == start else min(value, last - 10 * np.finfo(float).eps * norm)
        last = shift
        x = random.standard_normal(len(d))
        for _ in range(5):
            x = _solve(d, e, shift, x / np.linalg.norm(x))
            for _ in range(2):
                x -= out[start:k].T @ (out[start:k] @ x)
        out[k] = x / np.linalg.norm(x)
    return out


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as rows (largest entry positive)."""
    d, e, reflections = tridiagonal(covariance)
    values = leading_values(d, e, k)
    vectors = eigenvectors(d, e, values)
    for i, v in reversed(list(enumerate(reflections))):
        part = vectors[:, i + 1:]
        part -= 2 * np.outer(part @ v, v)
    big = vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]
    return values, vectors * np.where(big < 0, -1.0, 1.0)[:, None]


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; null where one does not fit into 64 bits."""
    worst = int(np.abs(centred).max(initial=0))
    if worst * worst * centred.shape[1] < 2 ** 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(c * c for c in row) for row in centred.tolist()]
    return [s if s < 2 ** 63 else None for s in exact]


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of rows(vec_id, x array<long>).

    One row for each vector of the fit list and component, from 1 by falling
    eigenvalue.  ``deviation`` is the sum over dimensions of (n x - S)**2,
    ``whitened`` the projection of x - S/n over the root of the eigenvalue,
    ``explained`` the eigenvalue's share of the trace and ``identity_error`` how
    far the covariance of ``whitened`` is from the identity.
    """
    kind = dict(rows.dtypes)["vec_id"]
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    own = stored(rows, "vectors")
    spark = rows.sparkSession
    # one row: the most frequent length, ties to the longer
    most = own.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    width, n = most["d"], most["count"]
    fit = own.where(F.size("x") == width)
    at = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"))
    sums = [s for _, s in sorted(map(tuple, at.collect()))]          # one number for each dimension
    middle = np.array([round(s / n) for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)])
    products = _products(width, lambda b: (_matrix(b.column(0), width) - middle).astype(float))
    v = _added(fit.select("x").mapInArrow(products, "i int, j int, s double"), width) / n - np.outer(rest, rest)
    if not v.any():                                                  # all vectors are equal
        return spark.createDataFrame([], schema)
    values, vectors = leading(v, min(components, width))
    kept = values > FLAT * max(values[0], 0.0)
    values, vectors = values[kept], vectors[kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)[:, None]
    explained = values / np.trace(v)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle).astype(float) - rest) @ scaled.T

    white = _products(k, lambda b: project(_matrix(b.column(0), width)))
    added = _added(fit.select("x").mapInArrow(white, "i int, j int, s double"), k) / n
    error = float(np.abs(added - np.eye(k)).max())
    exact = [n * int(m) - s for m, s in zip(middle, sums)]           # n x - S = n (x - middle) + this

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch.column(1), width)
            if len(x) and n * int(np.abs(x - middle).max()) >= 2 ** 62:
                centred = n * (x - middle).astype(object) + np.array(exact, object)
                deviation = [s if s < 2 ** 63 else None for s in (sum(c * c for c in r) for r in centred.tolist())]
            else:
                deviation = _deviations(n * (x - middle) + np.array(exact, np.int64))
            rows_of = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows_of), n)), pa.array(deviation, pa.int64()).take(pa.array(rows_of)),
                pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows_of), error))], names=[f.split()[0] for f in schema.split(", ")])

    return fit.select("vec_id", "x").mapInArrow(run, schema)
