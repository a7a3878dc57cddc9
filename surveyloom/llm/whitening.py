"""Whitening of embeddings: principal components of unit variance.

Vectors become whole numbers, so sums are exact however they are dealt: one pass
sums the dimensions, a second the products of vectors that are centred at the
rounded mean, whose rest is taken off exactly. The driver, which holds one
matrix of dims by dims, turns it diagonal by cyclic Jacobi rotations, which keep
small eigenvalues accurate, and broadcasts the whitening matrix. A third pass
measures the covariance of what comes out, and the last gives the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, broadcast_value, ship

SCALE, SHIFT = 1024, 100_000
#: The driver holds a matrix of so many rows and columns at most.
MAX_DIMS = 4096
#: Entries within 2^20 of the centre, 4096 vectors at a time, have products that sum
#: exactly in doubles; vectors with others are summed as Python's whole numbers.
NEAR, ROWS = 1 << 20, 4096
#: Sums travel as three parts of 40 bits, the last with all that is above.
BITS = 40
SUMS = "row int, low array<long>, mid array<long>, high array<long>"


def usable(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, x: array<long>) of vectors without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & F.coalesce(fits, F.lit(False)))
    rows = rows if dims is None else rows.filter(F.size("v") == dims)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _parts(values: np.ndarray) -> list[list[int]]:
    values = [int(v) for v in values]
    mask = (1 << BITS) - 1
    return [[v & mask for v in values], [v >> BITS & mask for v in values], [v >> 2 * BITS for v in values]]


def _whole(low, mid, high) -> list[int]:
    return [a + (b << BITS) + (c << 2 * BITS) for a, b, c in zip(low, mid, high)]


def _sums(rows: DataFrame, dims: int, made: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, list[int]]:
    """Exact sums over all vectors of what ``made`` gives for some of them, by row.

    A task adds up its own, then tasks add up a row's parts, and the driver gets
    one line a row: as many as there are dimensions.
    """

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for whole in arrow_slices([b]):
                x = _matrix(whole.column("x"), dims)
                for at in range(0, len(x), ROWS):
                    for k, v in made(x[at : at + ROWS]).items():
                        total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            yield _line(k, v)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, *parts in zip(b.column("row").to_pylist(), *(b.column(c) for c in ("low", "mid", "high"))):
                parts = [p.values.to_numpy() for p in parts]
                total[k] = [a + p for a, p in zip(total[k], parts)] if k in total else parts
        for k, parts in total.items():
            yield _line(k, np.array(_whole(*(p.tolist() for p in parts)), object))

    got = rows.select("x").mapInArrow(own, SUMS).repartition("row").mapInArrow(added, SUMS).collect()
    return {r["row"]: _whole(r["low"], r["mid"], r["high"]) for r in got}


def _line(row: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), *(pa.array([p], pa.list_(pa.int64())) for p in _parts(values))], ["row", "low", "mid", "high"])


def _split(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are near the centre, and which aren't."""
    near = (np.abs(y) < NEAR).all(axis=1)
    return np.flatnonzero(near), np.flatnonzero(~near)


def _column_sums(x: np.ndarray) -> dict[int, np.ndarray]:
    return {0: x.astype(object).sum(axis=0) if np.abs(x).max() > 2**62 // ROWS else x.sum(axis=0).astype(object), 1: np.array([len(x)], object)}


class Centre(NamedTuple):
    n: int
    sums: list[int]
    whole: np.ndarray  # the rounded mean
    rest: list[int]  # sums - n * whole

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        whole = [(2 * s + n) // (2 * n) for s in sums]
        return cls(n, sums, np.array(whole, np.int64), [s - n * w for s, w in zip(sums, whole)])


def covariance(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The covariance with divisor n, each entry exact but for one rounding."""
    dims, whole = len(centre.sums), centre.whole

    def products(x: np.ndarray) -> dict[int, np.ndarray]:
        y = x - whole
        near, far = _split(y)
        near = y[near].astype(np.float64)
        total = (near.T @ near).astype(np.int64).astype(object)
        if len(far):
            far = y[far].astype(object)
            total = total + far.T @ far
        return dict(enumerate(total))

    got = _sums(rows, dims, products)
    n, r = centre.n, centre.rest
    return np.array([[(n * got[i][j] - r[i] * r[j]) / (n * n) for j in range(dims)] for i in range(dims)])


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    Rotates (p, q) in turn, row by row, until every entry off the diagonal is
    within rounding of its two diagonal entries' geometric mean.
    """
    a = np.array(a, np.float64)
    d = len(a)
    vectors = np.eye(d)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if off == 0.0 or abs(off) <= eps * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s, tau = t * c, t * c / (1 + c)
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                for m in (a, vectors):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = x - s * (y + tau * x), y + s * (x - tau * y)
                a[p, :], a[q, :] = a[:, p], a[:, q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


class Whitening(NamedTuple):
    centre: Centre
    matrix: np.ndarray  # dims x components; columns of no variance are NaN
    values: np.ndarray  # eigenvalues of the components
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre.whole).astype(np.float64) - np.array([r / self.centre.n for r in self.centre.rest])
        return z @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sums of (n * x - S)^2 over dimensions, exact."""
        n, r = self.centre.n, self.centre.rest
        y = x - self.centre.whole
        near, far = _split(y)
        a, b = np.zeros(len(x), object), np.zeros(len(x), object)
        a[near] = (y[near] * y[near]).sum(axis=1)
        small = max(map(abs, r)) * NEAR * len(r) < 2**62
        b[near] = y[near] @ np.array(r, np.int64) if small else y[near].astype(object) @ np.array(r, object)
        if len(far):
            wide = y[far].astype(object)
            a[far], b[far] = (wide * wide).sum(axis=1), wide @ np.array(r, object)
        c = sum(v * v for v in r)
        return [n * n * int(s) - 2 * n * int(t) + c for s, t in zip(a, b)]


def fit(rows: DataFrame, dims: int, components: int) -> Whitening | None:
    """The whitening of all rows (vec_id, x); None without rows."""
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MAX_DIMS} are taken, as the driver holds their covariance")
    got = _sums(rows, dims, _column_sums)
    if not got:
        return None
    centre = Centre.of(got[1][0], got[0])
    v = covariance(rows, centre)
    values, vectors = jacobi(v)
    values, vectors = values[:components], vectors[:, :components]
    # What rounding alone can make of no variance at all along a vector.
    floor = dims * np.finfo(float).eps * (np.abs(vectors) * np.sqrt(np.diag(v))[:, None]).sum(axis=0) ** 2
    scale = np.where(values > floor, 1 / np.sqrt(np.where(values > floor, values, 1.0)), np.nan)
    return Whitening(centre, vectors * scale, values, float(np.trace(v)))


def identity_error(rows: DataFrame, whitening: Whitening, shared) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity, measured."""
    dims, kept = len(whitening.centre.sums), np.flatnonzero(~np.isnan(whitening.matrix[0]))
    if not len(kept):
        return None

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((len(kept), len(kept) + 1))
        for b in arrow_slices(batches):
            w = own.apply(_matrix(b.column("x"), dims))[:, kept]
            total += np.c_[w.T @ w, w.sum(axis=0)]
        i, j = map(np.ravel, np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((len(kept), len(kept) + 1))
    for r in rows.select("x").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"] / whitening.centre.n
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(len(kept))).max())


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a line for
    each vector and each of the first ``components`` components (all, if the
    vectors have fewer dimensions).

    Vectors that are null, empty or hold null or non-finite entries take no part,
    nor do those with entries of 2^52 or more, which make no long, or of another
    length than the table's most frequent one (of two, the smaller). A null vec_id
    stays null, and repeated rows count and come out as often as they are there. A
    component without variance, as of fewer vectors than dimensions, has a null
    ``whitened`` and takes no part in identity_error, which is null if none has
    any, as ``explained`` is. An empty table gives no rows; other columns play no
    part. ``deviation`` is null beyond 38 digits.
    """
    spark = embeddings.sparkSession
    ship(spark)
    common = usable(embeddings).groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], OUT)
    dims = common["dims"]
    rows = usable(embeddings, dims)
    found = fit(rows, dims, components)
    shared = broadcast_value(spark, found, found.matrix.nbytes + 100 * dims, 8 * MAX_DIMS * max(components, 1024), "whitening matrix")
    error = identity_error(rows, found, shared)
    explained = [v / found.trace if found.trace > 0 else None for v in np.maximum(found.values, 0.0).tolist()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in arrow_slices(batches, 1_000_000):
            x = _matrix(b.column("x"), dims)
            k, m = len(own.values), len(x)
            each = np.repeat(np.arange(m), k)
            dev = pa.array([Decimal(d) if d < 10**38 else None for d in own.deviation(x)], pa.decimal128(38, 0))
            w = own.apply(x).ravel()
            columns = [
                b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, own.centre.n)),
                dev.take(pa.array(each)), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
