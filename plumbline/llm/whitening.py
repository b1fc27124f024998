"""Whitening of embeddings by the leading components of their covariance.

Entries become integers first (``floor(scale * c) + shift``), so sums over any number of rows are exact.
Four passes over the table, each a map with sums of fixed size per task: sums, centred covariance,
projection (written), covariance of the result. The driver sees one d x d matrix per vector length d,
never a row. The leading eigenvectors come from Householder tridiagonalisation, bisection on Sturm
counts, and inverse iteration that orthogonalises within clusters of close eigenvalues.

Defined results: rows whose vector is null or holds null, NaN or infinite entries (or entries whose
integer needs more than 40 bits) are left out; so are vectors without entries, which have no component.
Vectors of different lengths have no common covariance: each length is a fit of its own, with its own n.
Repeated rows and repeated ids count and come out as often as they occur; a null id stays null. A component
whose eigenvalue is below ``RESOLVED`` of the largest can't be told from rounding: its ``whitened`` is null
and it takes no part in ``identity_error``. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import land, prepare

SCALE, SHIFT = 64, 1_000_000
# Largest magnitude of an entry's integer: sums of a batch then fit 64 bits.
MOST = float(1 << 40)
# Smallest eigenvalue, relative to the largest, that double precision tells from zero.
RESOLVED = 1e-11
# Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3


# --- symmetric eigenproblem ------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of the tridiagonal form of a symmetric matrix.

    Vector k reflects coordinates k + 1 and up; ``None`` stands for no reflection.
    """
    a = np.array(a, dtype=np.float64)
    n = len(a)
    vectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            vectors.append(None)
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -np.copysign(size, x[0])
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each point, how many eigenvalues of the tridiagonal matrix lie below it."""
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((off**2).max(initial=0.0)))
    q = diagonal[0] - points
    counts = np.zeros(len(points), dtype=np.int64)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - points - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < least, -least, q)
        counts += q < 0
    return counts


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    eps = np.finfo(float).eps
    span = max(float(np.abs(diagonal).max() + reach.max()), np.finfo(float).tiny)
    low = np.full(k, (diagonal - reach).min() - 4 * eps * span)
    high = np.full(k, (diagonal + reach).max() + 4 * eps * span)
    want = n - np.arange(k)  # the j-th largest has at least n - j eigenvalues below or at it
    while (high - low > 2 * eps * np.maximum(np.abs(low), np.abs(high)) + eps * eps * span).any():
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        below = sturm_counts(diagonal, off, middle) >= want
        high = np.where(below, middle, high)
        low = np.where(below, low, middle)
    return (low + high) / 2


class _Shifted:
    """LU factors, with row exchanges, of a tridiagonal matrix minus a multiple of the identity."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
        n = len(diagonal)
        d = [x - shift for x in diagonal.tolist()]
        upper, lower = off.tolist() + [0.0], off.tolist()
        second = [0.0] * n
        self.factors, self.swapped = [0.0] * max(n - 1, 0), [False] * max(n - 1, 0)
        for i in range(n - 1):
            if abs(d[i]) >= abs(lower[i]):
                pivot = d[i] if d[i] != 0 else least
                d[i] = pivot
                f = lower[i] / pivot
                d[i + 1] -= f * upper[i]
            else:
                f = d[i] / lower[i]
                self.swapped[i] = True
                d[i], next_diagonal = lower[i], d[i + 1]
                d[i + 1] = upper[i] - f * next_diagonal
                upper[i], second[i] = next_diagonal, upper[i + 1]
                upper[i + 1] = -f * second[i]
            self.factors[i] = f
        self.d = [x if abs(x) > least else (least if x >= 0 else -least) for x in d]
        self.upper, self.second = upper, second

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        n = len(y)
        for i in range(n - 1):
            if self.swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= self.factors[i] * y[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                y[i] -= self.upper[i] * y[i + 1]
            if i + 2 < n:
                y[i] -= self.second[i] * y[i + 2]
            y[i] /= self.d[i]
        return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for falling eigenvalues."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    eps = np.finfo(float).eps
    random = np.random.default_rng(0)
    found = np.zeros((n, len(values)))
    first, shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal shifts would give the same vector over and over: keep them apart by rounding's size
        shift = value if j == first else min(float(value), shift - 4 * eps * norm)
        factors = _Shifted(diagonal, off, float(shift), eps * norm)
        cluster = found[:, first:j]
        x = random.standard_normal(n)
        good = 0
        for _ in range(12):
            x = x / np.abs(x).max()
            x = factors.solve(x)
            x = x / np.linalg.norm(x)
            for _ in range(2):
                x = x - cluster @ (cluster.T @ x)
            size = np.linalg.norm(x)
            if size < 1e-8:  # fell into the cluster's earlier vectors
                x = random.standard_normal(n)
                continue
            x = x / size
            image = diagonal * x
            image[:-1] += off * x[1:]
            image[1:] += off * x[:-1]
            good += np.linalg.norm(image - value * x) <= 8 * eps * norm * np.sqrt(n)
            if good == 2:
                break
        found[:, j] = x
    return found


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(matrix))
    if not matrix.any():
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    size = float(np.abs(matrix).max())  # by a scale, squares neither overflow nor vanish
    matrix = matrix / size
    diagonal, off, vectors = tridiagonal(matrix)
    found = inverse_iteration(diagonal, off, leading_values(diagonal, off, k))
    for i in range(len(vectors) - 1, -1, -1):
        v = vectors[i]
        if v is not None:
            found[i + 1 :] -= 2 * np.outer(v, v @ found[i + 1 :])
    found /= np.linalg.norm(found, axis=0)
    values = np.einsum("ij,ij->j", found, matrix @ found)  # Rayleigh quotients: what whitening divides by
    order = np.argsort(-values, kind="stable")
    return values[order] * size, found[:, order]


# --- passes over the table -------------------------------------------------------------------


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the usable vectors in a list column, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        matrix = values[offsets[rows][:, None] + np.arange(length)]
        fine = (np.abs(matrix) < MOST).all(axis=1)  # false for NaN
        if fine.any():
            yield length, rows[fine], matrix[fine]


def _integers(matrix: np.ndarray, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose integers fit, and the integers."""
    scaled = np.floor(matrix * scale) + shift
    fine = (np.abs(scaled) < MOST).all(axis=1)
    return fine, scaled[fine].astype(np.int64)


class _Fit:
    """Mean and projection of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)  # exact part of the mean
        self.rest = np.array([s % n for s in sums], dtype=object)
        self.fraction = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exactly: n x - S = n (x - whole) - rest."""
        t = x - self.whole
        most, dims = int(np.abs(t).max(initial=0)), t.shape[1]
        rest = [int(r) for r in self.rest]
        if most * max(most, max(rest)) * dims < 1 << 62:
            squares, cross = (t * t).sum(axis=1).tolist(), (t @ np.array(rest, dtype=np.int64)).tolist()
        else:
            big = t.astype(object)
            squares, cross = (big * big).sum(axis=1).tolist(), (big * self.rest).sum(axis=1).tolist()
        constant = sum(r * r for r in rest)
        return [self.n * self.n * a - 2 * self.n * b + constant for a, b in zip(squares, cross)]


def _summed(parts: DataFrame) -> pd.DataFrame:
    """Sums over tasks of (dim, n, at, values): one row per dim, at and position in values."""
    flat = parts.select("dim", "at", "n", F.posexplode("values").alias("pos", "v"))
    return flat.groupBy("dim", "at", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()


def _sums(vectors: DataFrame, scale: int, shift: int) -> dict[int, _Fit]:
    def task(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for length, _, matrix in _matrices(batch.column("v")):
                _, x = _integers(matrix, scale, shift)
                n, sums = totals.get(length, (0, [0] * length))
                totals[length] = (n + len(x), [a + b for a, b in zip(sums, x.sum(axis=0).tolist())])
        for length, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))],
                names=["dim", "at", "n", "values"],
            )

    found = _summed(vectors.mapInArrow(task, "dim int, at int, n bigint, values array<decimal(38,0)>"))
    fits = {}
    for dim, rows in found.sort_values("pos").groupby("dim"):
        if int(rows["n"].iloc[0]):
            fits[int(dim)] = _Fit(int(rows["n"].iloc[0]), [int(v) for v in rows["v"]])
    return fits


def _covariances(rows: DataFrame, dims: dict[int, tuple[int, int]], prepared) -> dict[int, np.ndarray]:
    """Covariance per dim of the centred matrices that ``prepared(length, batch)`` yields.

    ``dims`` gives size and n of each. A task sums its outer products and hands out the upper triangle once.
    """

    def task(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, centred in prepared(batch):
                totals[dim] = totals.get(dim, 0) + centred.T @ centred
        for dim, total in totals.items():
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([0] * size, pa.int64()), pa.array([total[i, i:].tolist() for i in range(size)], pa.list_(pa.float64()))],
                names=["dim", "at", "n", "values"],
            )

    found = _summed(rows.mapInArrow(task, "dim int, at int, n bigint, values array<double>"))
    covariances = {}
    for dim, (size, n) in dims.items():
        part = found[found["dim"] == dim]
        matrix = np.zeros((size, size))
        i = part["at"].to_numpy(dtype=np.int64)
        j = i + part["pos"].to_numpy(dtype=np.int64)
        matrix[i, j] = matrix[j, i] = part["v"].to_numpy(dtype=np.float64) / n
        covariances[dim] = matrix
    return covariances


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), see above.

    A row per vector and component, components from 1 by falling eigenvalue. ``deviation`` (decimal) is the
    exact sum over dimensions of (n x - S)^2; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` the largest absolute entry of the whitened rows' covariance minus the identity.
    """
    spark = prepare(embeddings.sparkSession)
    vectors = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = _sums(vectors.select("v"), scale, shift)
    shared = spark.sparkContext.broadcast(fits)  # per length d: 2 d numbers

    def integers(batch):
        for length, rows, matrix in _matrices(batch.column("v")):
            fine, x = _integers(matrix, scale, shift)
            if length in shared.value and len(x):
                yield length, rows[fine], x

    def centred(batch):
        return ((length, shared.value[length].centred(x)) for length, _, x in integers(batch))

    axes, shares = {}, {}
    covariances = _covariances(vectors.select("v"), {dim: (dim, fit.n) for dim, fit in fits.items()}, centred)
    for dim, matrix in covariances.items():
        values, found = leading_components(matrix, components)
        resolved = int((values > RESOLVED * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        axes[dim] = found[:, :resolved] / np.sqrt(values[:resolved])
        trace = float(np.trace(matrix))
        shares[dim] = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values]
    projection = spark.sparkContext.broadcast(axes)  # per length d: d x components numbers

    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("dim int, n bigint, deviation decimal(38,0), w array<double>")])

    def project(batches):
        for batch in batches:
            for length, rows, x in integers(batch):
                fit, axis = shared.value[length], projection.value[length]
                whitened = fit.centred(x) @ axis
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * axis.shape[1], whitened.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(np.full(len(x), length), pa.int32()),
                        pa.array(np.full(len(x), fit.n), pa.int64()),
                        pa.array(fit.deviations(x), pa.decimal128(38, 0)),
                        flat,
                    ],
                    names=["vec_id", "dim", "n", "deviation", "w"],
                )

    projected = land(vectors.mapInArrow(project, schema))

    # the mean of whitened rows is zero but for rounding; it is taken off all the same
    sizes = {dim: (axis.shape[1], fits[dim].n) for dim, axis in axes.items() if axis.shape[1]}
    flat = projected.select("dim", F.posexplode("w").alias("at", "v")).groupBy("dim", "at").agg(F.avg("v").alias("v"))
    means: dict[int, np.ndarray] = {}
    for dim, rows in flat.toPandas().sort_values("at").groupby("dim"):
        means[int(dim)] = rows["v"].to_numpy()

    def whitened(batch):
        dims = batch.column("dim").to_numpy()
        for length, rows, matrix in _matrices(batch.column("w")):
            for dim in np.unique(dims[rows]).tolist():
                yield dim, matrix[dims[rows] == dim] - means[dim]

    errors = {dim: 0.0 for dim in axes}
    for dim, matrix in _covariances(projected.select("dim", "w"), sizes, whitened).items():
        errors[dim] = float(np.abs(matrix - np.eye(len(matrix))).max())

    facts = [(dim, i, share, errors[dim]) for dim, values in shares.items() for i, share in enumerate(values, 1)]
    facts = spark.createDataFrame(facts, "dim int, component int, explained double, identity_error double")
    return projected.join(F.broadcast(facts), "dim").select(  # a row per length and component
        F.col("vec_id").alias(id_col), "component", "n", "deviation", F.get("w", F.col("component") - 1).alias("whitened"), "explained", "identity_error"
    )
