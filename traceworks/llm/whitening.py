"""Whitening of vectors by shifted CholeskyQR: a few Gram passes over the rows, then the SVD of a small factor.

The rows A, centred first, are never factored whole. A pass adds up the Gram matrix of A R^-1, whose rows every task
works out by a triangular solve with the factor R known so far (nothing in the first pass); the Cholesky factor of that
sum is multiplied onto R. The first sum is shifted by a small multiple of the identity, so that the factor exists
however ill-conditioned the rows are; the next passes take the shift's error out again. They end when the sum is the
identity to rounding. A = Q R with Q orthonormal then, so the singular values and right vectors of R are those of A:
eigenvalues and eigenvectors of the covariance to double precision, without squaring its condition number.

Sums of the whole numbers x are exact, and a row is centred exactly, as n * x - S, before anything is multiplied. What
goes through the driver are d x d matrices for vectors of d entries, added up by (row, column) in a shuffle, whatever
the number of rows.

Defined results: rows with a null vector or a null or non-finite entry are left out; scaled entries beyond 2**31 on
either side count as that; shorter vectors count as filled up with zero entries. Repeated rows and rows without an id
are rows like any other. Components whose eigenvalue is nothing but rounding (constant or dependent dimensions, a
single row) have null in ``whitened`` and don't count in ``identity_error``, which is null if there are no others. An
empty table, or vectors without entries, give no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceworks.llm.vectors import matrix, usable, whole_steps

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
MOST = 1 << 31
#: Gram passes at most; three give double precision for any condition number that doubles can express.
PASSES = 6
#: Rows worked on at once in a task hold so many entries.
ENTRIES = 1 << 20
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): rows that take part, with their entries as whole numbers."""
    vector = F.col(vector_col)
    steps = F.transform(whole_steps(vector, SCALE, MOST), lambda e: e + OFFSET)
    return rows.where(usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), steps.alias("x"))


class Centred:
    """The numbers n * x - S of batches of rows, exact, and as doubles divided by n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.dims = n, np.array(sums, np.int64), len(sums)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, ENTRIES // self.dims)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                part = whole.slice(lo, step)
                x = matrix(part.column("x"), self.dims)
                # A shorter vector's missing entries are zeros before scaling and shifting.
                x[np.arange(self.dims) >= pc.list_value_length(part.column("x")).to_numpy()[:, None]] = OFFSET
                yield part, x * self.n - self.sums


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: of every dimension, the sum of x - OFFSET; in dimension -1 the number of rows."""
    n, total = 0, np.zeros(0, np.int64)
    for part in batches:
        n += part.num_rows
        dims = int(np.max(pc.list_value_length(part.column("x")).to_numpy(), initial=0))
        x = matrix(part.column("x"), dims)
        x[np.arange(dims) < pc.list_value_length(part.column("x")).to_numpy()[:, None]] -= OFFSET
        if dims > len(total):
            total = np.append(total, np.zeros(dims - len(total), np.int64))
        total[:dims] += x.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.append(n, total), pa.int64())],
                                     ["j", "s"])


def _gram(centred: Centred, project: Callable[[np.ndarray], np.ndarray], middle: np.ndarray | None = None):
    """Per task: the upper triangle of the Gram matrix of the projected rows, and in row -1 their sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums = None
        for _, exact in centred.batches(batches):
            q = project(exact / centred.n)
            if middle is not None:
                q = q - middle
            total = q.T @ q if total is None else total + q.T @ q
            sums = q.sum(axis=0) if sums is None else sums + q.sum(axis=0)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.full(len(sums), -1), i), pa.int32()),
                 pa.array(np.append(np.arange(len(sums)), j), pa.int32()), pa.array(np.append(sums, total[i, j]))], ["i", "j", "g"])

    return work


def gram(rows: DataFrame, centred: Centred, project: Callable[[np.ndarray], np.ndarray], width: int,
         middle: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix and the sums of the projected rows, added up over all tasks."""
    parts = rows.mapInArrow(_gram(centred, project, middle), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    out, sums = np.zeros((width, width)), np.zeros(width)
    for r in parts.collect():  # width * (width + 3) / 2 rows
        if r.i < 0:
            sums[r.j] = r.g
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.g
    return out, sums


def _solved(factor: np.ndarray | None) -> Callable[[np.ndarray], np.ndarray]:
    """Rows a to a R^-1, by forward substitution with the transposed factor over all rows at once."""

    def project(a: np.ndarray) -> np.ndarray:
        if factor is None:
            return a
        q = a.T.copy()
        for k in range(len(factor)):
            q[k] = (q[k] - factor[:k, k] @ q[:k]) / factor[k, k]
        return q.T

    return project


def _cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g + shift * 1; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-16 * max(np.trace(g), 1e-300))


def factor(rows: DataFrame, centred: Centred) -> np.ndarray:
    """R of the QR factorisation of the centred rows (up to the signs of its rows)."""
    d, n, r = centred.dims, centred.n, None
    for step in range(PASSES):
        g, _ = gram(rows, centred, _solved(r), d)
        norm = float(np.linalg.norm(g, 2))
        if not np.isfinite(norm):
            raise ArithmeticError("the rows' squares do not fit into doubles")
        if step and np.abs(g - np.eye(d)).max() < 1e-12 * d:
            break
        # Shift of the first pass: enough for the rounding errors of the sum and of the factorisation.
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * norm if not step else 0.0
        if not norm:
            return np.zeros((d, d))
        new = _cholesky(g, min(shift, norm / 100))
        r = new if r is None else new @ r
    return r


def _whitener(centred: Centred, directions: np.ndarray, scales: np.ndarray, shares: np.ndarray):
    """Every row's whitened values, one row per component."""
    width, squares = len(scales), centred.dims

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, exact in centred.batches(batches):
            bound = int(np.abs(exact).max(initial=0)) ** 2 * squares
            deviation = (exact ** 2).sum(axis=1).tolist() if bound < 1 << 63 else [
                sum(v * v for v in row) for row in exact.tolist()]
            values = _projected(directions, scales)(exact / centred.n)
            empty = np.tile(~(scales > 0), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(np.repeat(np.arange(part.num_rows), width))),
                 pa.array(np.tile(np.arange(1, width + 1), part.num_rows), pa.int32()),
                 pa.array(np.full(part.num_rows * width, centred.n), pa.int64()),
                 pa.array([v for v in deviation for _ in range(width)], pa.decimal128(38, 0)),
                 pa.array(values.ravel(), pa.float64(), mask=empty), pa.array(np.tile(shares, part.num_rows))],
                [c.split()[0] for c in OUT.replace("(38,0)", "").split(", ")])

    return work


def _projected(directions: np.ndarray, scales: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    over = np.divide(1.0, scales, out=np.zeros_like(scales), where=scales > 0)
    return lambda a: (a @ directions) * over


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    ``deviation`` is the exact sum of (n * x - S)^2 over the dimensions, ``explained`` a component's share of the trace
    of the covariance, ``identity_error`` the largest entry by which the covariance of ``whitened`` is off the identity.
    """
    rows = prepared(rows, id_col, vector_col)
    totals = {r.j: r.s for r in rows.mapInArrow(_totals, "j int, s long").groupBy("j").agg(F.sum("s").alias("s")).collect()}
    n, dims = totals.get(-1, 0), max(totals, default=-1) + 1
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], f"{OUT}, identity_error double")
    centred = Centred(n, [totals[j] + n * OFFSET for j in range(dims)])
    r = factor(rows, centred)
    _, sigma, turned = np.linalg.svd(r)
    width = min(components, dims)
    values = sigma ** 2 / n
    trace = values.sum()
    shares = values / trace if trace else np.zeros(dims)
    # Singular values below rounding of the largest stand for dependent dimensions.
    real = sigma > sigma[0] * 1e-12 * dims if sigma[0] else np.zeros(dims, bool)
    scales = np.where(real, np.sqrt(values), 0.0)[:width]
    directions = np.ascontiguousarray(turned[:width].T)
    project = _projected(directions, scales)
    _, sums = gram(rows, centred, project, width)
    covariance, _ = gram(rows, centred, project, width, sums / n)
    used = scales > 0
    off = np.abs(covariance / n - np.eye(width))[np.ix_(used, used)]
    error: Column = F.lit(float(off.max()) if off.size else None).cast("double")
    return rows.mapInArrow(_whitener(centred, directions, scales, shares[:width]), OUT).withColumn("identity_error", error)
