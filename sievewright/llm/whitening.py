"""Whitening of embeddings by the eigenvectors of their covariance.

Each partition streams through its vectors and updates count, exact sums, mean and the matrix of centred products by
Welford's rank-one step. The partitions' states are merged by the parallel update formula, FAN of them at first and then
the rest, so that a task holds one state beside the one it reads; a state has the vectors' dimensions squared. What
reaches the driver is one state for each length of vector. Its eigenvectors come from a symmetric QR solver: Householder
reflections to tridiagonal form, then implicit shifted steps.

Three passes read the vectors: the state, the state of the whitened vectors, which gives the measured identity error,
and the result. Nothing is moved but states.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries (or entries that a long can't hold
when scaled) are left out; a null id is kept; repeated rows count as often as they stand; vectors of each length are fit
on their own; components without variance have a null `whitened` and take no part in the identity error, `explained` is 0
where there is no variance at all; a `deviation` beyond 64 bits is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, vectors_of

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 32
#: Share of the largest eigenvalue below which there is no variance but rounding.
FLAT = 1e-13
ROWS = 512
_STATE = "dim int, n long, sums array<decimal(38,0)>, origin array<double>, mean array<double>, products array<double>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(c: np.ndarray) -> np.ndarray:
    """Whole numbers, as doubles; not finite where a long can't hold them."""
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE) + SHIFT
    return np.where(np.abs(x) < 2.0**62, x, np.inf)


class State:
    """Count, exact sums, mean and centred products of vectors. Means are kept as differences to an origin, the first vector, so that entries far from 0 cost no digits."""

    def __init__(self, dim: int, n: int = 0, sums: list[int] | None = None, origin: np.ndarray | None = None, mean: np.ndarray | None = None, products: np.ndarray | None = None):
        self.n, self.sums, self.origin = n, sums if sums is not None else [0] * dim, origin
        self.mean = np.zeros(dim) if mean is None else mean
        self.products = np.zeros((dim, dim)) if products is None else products

    def add(self, rows: np.ndarray) -> None:
        """Welford's step for each row."""
        if self.origin is None:
            self.origin = rows[0].copy()
        for x in rows - self.origin:
            self.n += 1
            d = x - self.mean
            self.mean += d / self.n
            self.products += np.outer(d, x - self.mean)

    def add_sums(self, whole: np.ndarray) -> None:
        fits = float(np.abs(whole).max(initial=0)) * max(1, len(whole)) < 2.0**62
        column = whole.astype(np.int64) if fits else whole.astype(np.int64).astype(object)
        self.sums = [a + int(b) for a, b in zip(self.sums, column.sum(axis=0), strict=True)]

    def merge(self, other: State) -> None:
        """The parallel update formula."""
        if not self.n:
            self.origin = other.origin
        n = self.n + other.n
        d = (other.origin - self.origin) + (other.mean - self.mean)
        self.mean = self.mean + d * (other.n / n)
        self.products = self.products + other.products + np.outer(d, d) * (self.n * (other.n / n))
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    @property
    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


def _to_rows(states: dict[int, State]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
    for dim, s in sorted(states.items()):
        cols = ([dim], [s.n], [[Decimal(x) for x in s.sums]], [s.origin], [s.mean], [s.products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["dim", "n", "sums", "origin", "mean", "products"])


def _from_row(dim: int, n: int, sums, origin, mean, products) -> State:
    return State(dim, n, [int(x) for x in sums], np.array(origin, dtype=float), np.array(mean, dtype=float), np.array(products, dtype=float).reshape(dim, dim))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, State] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = [x[i].as_py() for x in batch.columns]
            states.setdefault(row[0], State(row[0])).merge(_from_row(*row))
    yield from _to_rows(states)


def states_of(vectors: DataFrame, change=None) -> dict[int, State]:
    """The state of all vectors of each length. vectors: (id, v); change(x) -> y: what to take instead of the scaled vectors."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for _, x in vectors_of(batch.column(1).slice(at, ROWS), scaled):
                    y = x if change is None else change(x)
                    s = states.setdefault(x.shape[1], State(y.shape[1]))
                    s.add(y)
                    if change is None:
                        s.add_sums(x)
        yield from _to_rows(states if change is None else {s.mean.size: s for s in states.values()})

    part = vectors.mapInArrow(run, _STATE)
    whole = part.repartition(FAN, F.spark_partition_id()).mapInArrow(_merged, _STATE).coalesce(1).mapInArrow(_merged, _STATE)
    return {r.dim: _from_row(*r) for r in whole.collect()}  # a row for each length of vector


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, sub-diagonal, q) with q' a q tridiagonal, by Householder reflections."""
    a = a.copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0:
            continue
        v = x.copy()
        v[0] += math.copysign(length, x[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (p @ v) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -math.copysign(length, x[0])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns: symmetric QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(a)
    n, eps = len(d), np.finfo(float).eps
    hi = n - 1
    least = eps * np.abs(a).max(initial=0) * eps
    for _ in range(60 * n):
        e[np.abs(e) <= np.maximum(eps * (np.abs(d[:-1]) + np.abs(d[1:])), least)] = 0
        while hi > 0 and e[hi - 1] == 0:
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        b = e[hi - 1]
        shift = d[hi] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, u = d[k], e[k], d[k + 1]
            d[k] = c * c * p + 2 * c * s * t + s * s * u
            d[k + 1] = s * s * p - 2 * c * s * t + c * c * u
            e[k] = c * s * (u - p) + (c * c - s * s) * t
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            one = q[:, k].copy()
            q[:, k] = c * one + s * q[:, k + 1]
            q[:, k + 1] = c * q[:, k + 1] - s * one
    else:
        raise ArithmeticError("the QR steps didn't converge")
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - sum) ** 2 for each row, exact; None beyond 64 bits."""
    most = n * float(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most < 2.0**62:
        apart = x.astype(np.int64) * n - np.array(sums, dtype=np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return (apart * apart).sum(axis=1).tolist()
        apart = apart.astype(object)
    else:
        apart = x.astype(np.int64).astype(object) * n - np.array(sums, dtype=object)
    return [d if d < 2**63 else None for d in map(int, (apart * apart).sum(axis=1))]


class Fit:
    """Means and components of the vectors of one length."""

    def __init__(self, state: State, components: int):
        self.n, self.sums = state.n, state.sums
        values, vectors = eigen(state.covariance)
        total = float(np.trace(state.covariance))
        k = min(components, len(values))
        self.mean = np.array([s / state.n for s in state.sums])
        self.some = values[:k] > FLAT * max(values.max(initial=0), 0)
        self.project = vectors[:, :k] / np.sqrt(np.where(self.some, values[:k], 1))
        self.explained = values[:k].clip(0) / total if total > 0 else np.zeros(k)
        self.error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.project


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = df.sparkSession
    ship(spark)
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fits = {dim: Fit(s, components) for dim, s in states_of(vectors).items()}
    for dim, fit in fits.items():
        some = np.flatnonzero(fit.some)
        if len(some):
            # the mean of the other lengths' vectors isn't theirs, so each length is measured alone
            made = states_of(vectors.filter(F.size("v") == dim), lambda x, fit=fit, some=some: fit.whiten(x)[:, some])
            fit.error = float(np.abs(made[len(some)].covariance - np.eye(len(some))).max())
    held = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for rows, x in vectors_of(part.column(1), scaled):
                    fit = held.value[x.shape[1]]
                    k, m = len(fit.explained), len(rows)
                    ids = part.column(0).take(pa.array(np.repeat(rows, k)))
                    deviation = pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                    white = pa.array(fit.whiten(x).ravel(), mask=np.tile(~fit.some, m))
                    cols = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fit.n)), deviation, white, pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, fit.error))]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, RESULT)
