"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Vectors become whole numbers, ``floor(scale * c)``. The fit list holds each distinct vector once. Spark sums it per
dimension, then sums the products of the vectors less the rounded mean; as entries are whole numbers, the part of
the mean left after rounding is taken out exactly and can't cancel. The driver gets ``d x d`` sums at any number
of rows, factors them as ``V = P L L' P'`` with pivots, and rotates pairs of columns of ``L`` until all are
orthogonal. ``V`` is never diagonalised itself: the squared norms of the rotated columns are its eigenvalues
(relatively exact, small ones too), the normalised columns its components.

Edge cases: a null vector, or one with a null, NaN or infinite entry, is left out; entries beyond a long are set to
its ends. A vector shorter than the longest is filled with zeros. Repeated rows each get their results but enter
the fit once; tied eigenvalues may be rotated among themselves, but the same way for all rows. Components beyond
the rank have eigenvalue 0 and a null ``whitened``; one distinct vector has rank 0 and a null ``explained``; vectors
without entries have no components and so no rows. A ``deviation`` beyond a long is null. An empty table gives an
empty result. Columns other than key and vector are not returned, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut

SCALE = 256
CHUNK = 4096  # rows multiplied at once
LIMIT = 2**63 - 1


@dataclass
class Model:
    """Whole sums and the components of a fit list: bounded by the dimension."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # dimension x kept components
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, name: str = "x") -> DataFrame:
    """Add ``name``, the vector in whole numbers, and leave out the rows without a finite vector."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    return rows.filter(F.col(vector).isNotNull() & finite).withColumn(name, whole)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as longs, filled up with zeros to ``dims``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            yield matrix(batch.column(0).slice(start, CHUNK), dims)


def summed(fit_list: DataFrame, dims: int, column: str) -> list[int]:
    """Exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for x in chunks(batches, dims):
            safe = not x.size or max(abs(int(x.min())), abs(int(x.max()))) <= LIMIT // CHUNK
            part = (x if safe else x.astype(object)).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(v) for v in total])], names=["i", "v"])

    parts = fit_list.select(column).mapInArrow(add, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r.i: int(r.v) for r in parts.collect()}  # one row per dimension
    return [found.get(i, 0) for i in range(dims)]


def scatter(fit_list: DataFrame, n: int, sums: list[int], column: str) -> np.ndarray:
    """The covariance of the fit list, divisor ``n``: products of centred entries, summed by task, then by Spark."""
    dims = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the rounded mean
    middle = np.array(centre, dtype=np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for x in chunks(batches, dims):
            z = x.astype(float) - middle if x.size and max(abs(int(x.min())), abs(int(x.max()))) > LIMIT // 2 else (x - middle).astype(float)
            total += z.T @ z
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = fit_list.select(column).mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for r in parts.collect():  # dims x (dims + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.v
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre, strict=True)])  # within half a unit
    return out / n - np.outer(rest, rest)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` (dimension x rank, rows in the order of ``v``) with ``L L' = v``; the largest diagonal entry left is the next pivot."""
    work, columns = v.astype(float).copy(), []
    floor = len(v) * np.finfo(float).eps * max(np.diag(v).max(initial=0.0), 0.0)
    for _ in range(len(v)):
        pivot = int(np.argmax(np.diag(work)))
        if not work[pivot, pivot] > floor:
            break
        column = work[:, pivot] / np.sqrt(work[pivot, pivot])
        columns.append(column)
        work -= np.outer(column, column)
        work[pivot, :] = work[:, pivot] = 0.0
    return np.array(columns).T.reshape(len(v), len(columns))


def tournament(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together hold each pair of 0..n-1 once."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(a, b) < n]
        if pairs:
            yield np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60, tolerance: float = 4e-16) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``factor factor'`` from rotations of its columns."""
    a = factor.astype(float).copy()
    for _ in range(sweeps):
        turned = False
        for p, q in tournament(a.shape[1]):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta) * np.sqrt(len(a))
            if not turn.any():
                continue
            turned = True
            gamma_ = np.where(turn, gamma, 1.0)
            zeta = (beta - alpha) / (2 * gamma_)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = np.where(turn, 1 / np.hypot(1.0, tangent), 1.0)
            sine = np.where(turn, cosine * tangent, 0.0)
            a[:, p], a[:, q] = cosine * x - sine * y, sine * x + cosine * y
        if not turned:
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], a[:, order] / np.sqrt(values[order])


def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """``n * x - S``: as longs if they hold it and the sum of its squares, as Python's whole numbers otherwise."""
    most = max([abs(s) for s in model.sums], default=0) + model.n * (max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0)
    if most * most * max(model.dims, 1) <= LIMIT:
        return x * model.n - np.array(model.sums, dtype=np.int64)
    return x.astype(object) * model.n - np.array(model.sums, dtype=object)


def projected(x: np.ndarray, model: Model, components: int) -> np.ndarray:
    """Whitened coordinates for the first ``components`` with a positive eigenvalue."""
    kept = min(components, len(model.eigenvalues))
    return (deviations(x, model).astype(float) / model.n) @ model.components[:, :kept] / np.sqrt(model.eigenvalues[:kept])


def off_identity(fit_list: DataFrame, model: Model, components: int, column: str) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened coordinates minus the identity, measured over all of it."""
    kept = min(components, len(model.eigenvalues))
    if not kept:
        return None
    dims = model.dims

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept + 1))
        for x in chunks(batches, dims):
            w = np.concatenate((projected(x, model, kept), np.ones((len(x), 1))), axis=1)
            total += w.T @ w
        i, j = np.divmod(np.arange(total.size), kept + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((kept + 1, kept + 1))
    for r in fit_list.select(column).mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[:-1, -1] / model.n  # rounding only: the coordinates are centred
    return float(np.abs(total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(kept)).max())


def fit(rows: DataFrame, components: int, column: str = "x") -> Model:
    """Fit on the distinct vectors in ``column`` (whole numbers, no nulls)."""
    dims = rows.agg(F.max(F.size(column)).alias("dims")).first().dims or 0
    if not dims:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    padded = F.concat(F.col(column), F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size(column)))
    fit_list = cut(rows.select(padded.alias(column)).distinct(), "vectors")
    n = fit_list.count()
    sums = summed(fit_list, dims, column)
    v = scatter(fit_list, n, sums, column)
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    model = Model(n, sums, values, vectors, float(np.trace(v)))
    model.identity_error = off_identity(fit_list, model, components, column)
    return model


def transformed(rows: DataFrame, model: Model, components: int, key: str, column: str = "x") -> DataFrame:
    """One row per row of ``rows`` and component."""
    dims, shown = model.dims, min(components, model.dims)
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType)] + [
        T.StructField(name, kind) for name, kind in (
            ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
            ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError(f"the key may not be named {key}")
    explained = np.zeros(shown)
    explained[:len(model.eigenvalues)] = model.eigenvalues[:shown] / (model.trace or 1.0)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if shown else 0, CHUNK):
                part = batch.slice(start, CHUNK)
                x, rows_in = matrix(part.column(1), dims), part.num_rows
                off = deviations(x, model)
                squares = [v if v <= LIMIT else None for v in (off * off).sum(axis=1).tolist()]
                white = np.full((rows_in, shown), np.nan)
                known = projected(x, model, shown)
                white[:, :known.shape[1]] = known
                repeat = np.repeat(np.arange(rows_in), shown)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), rows_in)),
                     pa.array(np.full(len(repeat), model.n, dtype=np.int64)), pa.array(squares, pa.int64()).take(pa.array(repeat)),
                     pa.array(white.ravel(), from_pandas=True),
                     pa.array(np.tile(explained, rows_in)) if model.trace else pa.nulls(len(repeat), pa.float64()),
                     pa.array([model.identity_error] * len(repeat), pa.float64())], names=schema.names)

    return rows.select(key, column).mapInArrow(whiten, schema)


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error) for every finite vector."""
    rows = quantised(vectors.select(F.col(key), F.col(vector).alias("_vector")), "_vector", scale, "_x").select(key, "_x")
    return transformed(rows, fit(rows, components, "_x"), components, key, "_x")
