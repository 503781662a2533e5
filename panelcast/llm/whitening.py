"""Whitening of vectors by polarisation: covariances from differences of variances.

Entries become integers x = floor(scale * c) + OFFSET. Two aggregates, whose partial sums are exact integers:

1. the count n and per dimension the sum S;
2. for every dimension i and every pair i < j the sum of squares of the centred u_i and of the centred
   u_i + u_j, where u = x - m and m is the integer nearest to S / n. What u lacks to a mean of zero (r = S - n m, less
   than one unit a row) comes off in exact integers: sum (n x - S)^2 = n^2 sum u^2 - n r^2, the pair sums alike.

No product of two dimensions is ever summed: half of var(i + j) - var(i) - var(j) is the covariance.
The exact d x d matrix is divided once and goes to ``eigh`` on the driver (d^2 numbers, whatever the rows). ``transform``
projects x - S / n on the components and divides by the root of the eigenvalue, in one map pass.

Vectors that are null or hold null or non-finite entries are dropped; shorter ones count as if zeros followed; rows of one
id, equal vectors and rows without an id each count and are returned; a component without variance (an eigenvalue not
above ``TINY`` of the largest) has a null ``whitened`` and takes no part in the identity error; an empty table gives no
rows. Entries have to fit in a long and sums in 38 digits; else the job fails, never wraps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import saved
from panelcast.llm.vectors import finite, matrix

OFFSET = 1_000_000
TINY = 1e-12
_ROWS = 2_048
_SUM = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """n, S per dimension, the exact centred squares as a covariance, and its eigenvectors (columns) by falling value."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return len(self.sums)


def integers(vectors: DataFrame, vec_col: str, scale: int, columns: list[str]) -> DataFrame:
    """The rows that take part, with floor(scale * c) as ``__v``."""
    floors = F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(finite(vec_col)).select(*columns, floors.alias("__v"))


def _exact(x: np.ndarray, rows: int, factor: int) -> np.ndarray:
    """``x``, as Python integers where sums over ``rows`` of its squares (times ``factor``) might leave 63 bits."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x if most * most * factor * max(rows, 1) < 2 ** 63 else x.astype(object)


def _sums(base: DataFrame, dim: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = matrix(batch.column("__v"), dim, np.int64)
            count += len(x)
            total += (x.astype(object) if len(x) and np.abs(x).max() * float(len(x)) > 2 ** 62 else x).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*total.tolist(), count], _SUM)], ["i", "s"])

    rows = base.select("__v").mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}
    n = sums.get(dim, 0)
    return n, [sums.get(i, 0) + n * OFFSET for i in range(dim)]


def squares(u: np.ndarray) -> dict[tuple[int, int], int]:
    """Sum over the rows of u_i^2 at (i, i) and of (u_i + u_j)^2 at (i, j)."""
    dim, out = u.shape[1], {}
    for at in range(0, len(u), _ROWS):
        t = np.ascontiguousarray(u[at:at + _ROWS].T)
        t = _exact(t, t.shape[1], 4)
        for i in range(dim):
            both = t[i + 1:] + t[i]
            own = (t[i] * t[i]).sum()
            for j, s in zip(range(i, dim), [own, *(both * both).sum(1)], strict=True):
                out[i, j] = out.get((i, j), 0) + int(s)
    return out


def _squares(base: DataFrame, dim: int, centre: list[int]) -> dict[tuple[int, int], int]:
    shift = np.array([m - OFFSET for m in centre], np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, s in squares(matrix(batch.column("__v"), dim, np.int64) - shift).items():
                total[key] = total.get(key, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                          pa.array(list(total.values()), _SUM)], ["i", "j", "s"])

    rows = (base.select("__v").mapInArrow(partial, "i int, j int, s decimal(38,0)")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    return {(r["i"], r["j"]): int(r["s"]) for r in rows}


def polarised(sums: dict[tuple[int, int], int], n: int, rest: list[int]) -> list[list[int]]:
    """n^3 times the covariance matrix, in exact integers, from the squares of u and of pair sums of u."""
    dim = len(rest)
    square = {(i, j): n * n * s - n * (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), s in sums.items()}
    out = [[0] * dim for _ in range(dim)]
    for i in range(dim):
        out[i][i] = square[i, i]
        for j in range(i + 1, dim):
            out[i][j] = out[j][i] = (square[i, j] - square[i, i] - square[j, j]) // 2
    return out


def fit(base: DataFrame, scale: int) -> Whitening:
    """The model of an ``integers`` frame (read twice: write it first where it is costly)."""
    dim = base.agg(F.max(F.size("__v"))).first()[0] or 0
    n, sums = _sums(base, dim) if dim else (0, [])
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), scale)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    whole = polarised(_squares(base, dim, centre), n, [s - n * m for s, m in zip(sums, centre, strict=True)])
    covariance = np.array([[x / n ** 3 for x in row] for row in whole])
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, covariance, values[::-1].copy(), vectors[:, ::-1].copy(), scale)


def _projected(y: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """Whitened rows (NaN where a component has no variance); y = x - OFFSET."""
    n = model.n
    centre = [(2 * s + n) // (2 * n) for s in model.sums]
    mean = np.array([(s - n * m) / n for s, m in zip(model.sums, centre, strict=True)])
    u = (y - np.array([m - OFFSET for m in centre], np.int64)).astype(np.float64) - mean
    e = model.values[:k]
    good = e > TINY * max(model.values[0], 0.0)
    return u @ model.vectors[:, :k] * np.where(good, 1 / np.sqrt(np.where(good, e, 1.0)), np.nan)


def identity_error(base: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(matrix(batch.column("__v"), model.dim, np.int64), model, k)
            first += w.sum(0)
            second += w.T @ w
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(np.vstack([second, first[None]]).reshape(-1))], ["i", "j", "s"])

    out = np.zeros((k + 1, k))
    for r in base.select("__v").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    mean = out[k] / model.n   # rounding only: the rows are centred
    error = np.abs(out[:k] / model.n - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(error)) if not np.isnan(error).all() else 0.0


def deviations(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum over the dimensions of (n x - S)^2, exact."""
    n, shift = model.n, [s - model.n * OFFSET for s in model.sums]
    most = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) * n + max((abs(s) for s in shift), default=0)
    if most * most * max(len(shift), 1) < 2 ** 63:
        return ((y * n - np.array(shift, np.int64)) ** 2).sum(1)
    whole = y.astype(object) * n - np.array(shift, object)
    return pa.array((whole * whole).sum(1).tolist(), pa.int64()).to_numpy()   # fails where a long is too small


def transform(base: DataFrame, model: Whitening, k: int, error: float, id_col: str) -> DataFrame:
    """One row per row of ``base`` and component."""
    k = min(k, model.dim)
    trace = float(np.trace(model.covariance))
    share = [float(e) / trace if trace > 0 else None for e in model.values[:k]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                y, m = matrix(part.column("__v"), model.dim, np.int64), len(part)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(deviations(y, model)).take(each),
                    pa.array(_projected(y, model, k).reshape(-1), from_pandas=True), pa.array(share * m, pa.float64()),
                    pa.array(np.full(m * k, error))], shape.names)

    shape = T.StructType([base.schema[id_col], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    return base.select(id_col, "__v").mapInArrow(rows, shape)


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that takes part and its first ``k``
    components. The integers are written once and read by every pass."""
    base = saved(integers(vectors, vec_col, scale, [id_col]), "integers")
    model = fit(base, scale)
    return transform(base, model, k, identity_error(base, model, min(k, model.dim)) if model.n else 0.0, id_col)
