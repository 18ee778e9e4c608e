"""Embedding whitening by polarisation covariance.

Covariances come from variances alone: the variance of the sum of two dimensions exceeds the sum of their variances by
twice their covariance. Entries are whole numbers, so for every dimension and every sum of two dimensions the squared
centred values are added up exactly: tasks add squares around a whole number near the mean, and the few sums are moved
to the mean itself as integers of any size. The covariance matrix is then rounded once, an entry at a time, and goes
to a symmetric eigensolver. Sums are a row per pair of dimensions and task; D (D + 1) / 2 of them reach the driver, so
dimensions should be some thousands at most. Nothing else grows there, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.session import written

#: Entries become whole numbers as floor(SCALE * c) + OFFSET; how many components are returned.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16

#: Scaled entries are held within this size, so that they and their offset are longs.
LARGEST = 1 << 52

#: Vectors that are squared at a time.
BLOCK = 1024


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n distinct vectors, their exact sums by dimension, eigenvalues by fall, and unit eigenvectors (a
    column each) of the components kept."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]

    @property
    def centre(self) -> tuple[np.ndarray, list[int]]:
        """Whole numbers just below the means, and n times what is left to the means."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), [s - self.n * w for s, w in zip(self.sums, whole)]


def _finite(v: Column) -> Column:
    return F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def whole_numbers(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, x) of the rows that can be whitened. Left out are rows whose vector is null or empty or has null or
    non-finite entries, and rows of another length than most have (the greater length of two equally frequent)."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    good = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(_finite(F.col("v")), F.lit(False)))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    good = good.where(F.size("v") == (lengths.d if lengths else 0))

    def whole(e: Column) -> Column:
        scaled = F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e.cast("double") * SCALE))
        return F.floor(scaled).cast("bigint") + OFFSET

    return good.select("id", F.transform("v", whole).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The vectors of a batch, one a row."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _exact_sums(df: DataFrame, sums: Callable[[np.ndarray], Iterator[tuple[int, list]]]) -> dict[int, int]:
    """Totals over the vectors of df (column x): sums(block) gives (first key, values), integers of any size.

    A task adds up its own and hands on one row a key, and aggregates add up the tasks'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            rows = _matrix(batch, 0) if batch.num_rows else ()
            for at in range(0, len(rows), BLOCK):
                for key, values in sums(rows[at : at + BLOCK]):
                    old = totals.get(key)
                    totals[key] = values if old is None else [a + b for a, b in zip(old, values)]
        for key, values in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(key, key + len(values)), pa.int64()), pa.array(map(Decimal, values), pa.decimal128(38, 0))],
                names=["k", "total"],
            )

    totals = df.select("x").mapInArrow(run, "k bigint, total decimal(38,0)").groupBy("k").agg(F.sum("total").alias("total"))
    return {r.k: int(r.total) for r in totals.collect()}


def _counts_and_sums(rows: np.ndarray) -> Iterator[tuple[int, list]]:
    # Halves of the numbers, so that a block's sum cannot pass 64 bits.
    high, low = (rows >> 26).sum(axis=0).tolist(), (rows & ((1 << 26) - 1)).sum(axis=0).tolist()
    yield 0, [len(rows)]
    yield 1, [(h << 26) + lo for h, lo in zip(high, low)]


def _pair_squares(centre: np.ndarray) -> Callable[[np.ndarray], Iterator[tuple[int, list]]]:
    """Sums of squares of c_j (key j D + j) and of c_j + c_k (key j D + k, j < k), c centred."""

    def sums(rows: np.ndarray) -> Iterator[tuple[int, list]]:
        c = np.ascontiguousarray((rows - centre).T)
        d = len(c)
        if int(np.abs(c).max()) >= 1 << 25:  # Their squares' sum may pass 64 bits.
            c = c.astype(object)
        for j in range(d):
            both = c[j:] + c[j]
            both[0] = c[j]
            yield j * d + j, [int(v) for v in (both * both).sum(axis=1)]

    return sums


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of x (column x, each taken as it comes), or None if there are none.

    Components whose eigenvalue is zero up to rounding are left out: nothing varies along them.
    """
    found = _exact_sums(x, _counts_and_sums)
    if not found:
        return None
    n = found.pop(0)
    sums = [found[k] for k in sorted(found)]
    model = Whitening(n, sums, 0.0, np.empty(0), np.empty((len(sums), 0)))
    centre, rest = model.centre
    squares = _exact_sums(x, _pair_squares(centre))
    d = len(sums)
    # n^2 times the sum of squares around the mean, from that around the centre: of n c - r, where r sums up n c.
    own = [n * n * squares[j * d + j] - n * rest[j] ** 2 for j in range(d)]
    cov = np.empty((d, d))
    for j in range(d):
        cov[j, j] = own[j] / n**3
        for k in range(j + 1, d):
            both = n * n * squares[j * d + k] - n * (rest[j] + rest[k]) ** 2
            cov[j, k] = cov[k, j] = (both - own[j] - own[k]) / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > max(values[0], 0.0) * d * np.finfo(float).eps).sum())
    return Whitening(n, sums, sum(own) / n**3, values[:kept].copy(), vectors[:, :kept].copy())


def _projected(rows: np.ndarray, model: Whitening) -> np.ndarray:
    centre, rest = model.centre
    centred = (rows - centre) - np.array([r / model.n for r in rest])
    return centred @ (model.eigenvectors / np.sqrt(model.eigenvalues))


def _deviations(rows: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2; None where that is no long."""
    centre, rest = model.centre
    c = rows - centre
    largest = (int(np.abs(c).max()) + 1) * model.n
    if largest * largest * c.shape[1] < 1 << 62:
        d = c * model.n - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    big = (sum((v * model.n - r) ** 2 for v, r in zip(row, rest)) for row in c.tolist())
    return [v if v < 1 << 63 else None for v in big]


def apply(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) per row of x (id, x): whitened has an entry per component."""
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch, 1)
                made = pa.array(list(_projected(rows, model)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_deviations(rows, model), pa.int64()), made],
                    names=["id", "deviation", "whitened"],
                )

    return x.select("id", "x").mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors of x (column x) minus the identity."""
    p = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + p * p)
        for batch in batches:
            if batch.num_rows:
                w = _projected(_matrix(batch, 0), model)
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int64()), pa.array(total, pa.float64())], names=["k", "total"]
        )

    rows = x.select("x").mapInArrow(run, "k bigint, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    total = np.array([r.total for r in sorted(rows)]) / model.n
    # The vectors are centred already; what rounding left of the mean is taken off.
    cov = total[p:].reshape(p, p) - np.outer(total[:p], total[:p])
    return float(np.abs(cov - np.eye(p)).max()) if p else 0.0


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> tuple[DataFrame, Whitening | None, float]:
    """The whitened vectors (id, deviation, whitened), what was fitted, and its identity error.

    Fitted is each distinct vector of whole numbers once; whitened is every row that has such a vector, also one that
    repeats. Left out are the rows that `whole_numbers` leaves out; a null id is kept. Entries beyond 2^46 in size
    count as that. Where nothing varies (one distinct vector) there are no components. Without vectors there are no
    rows, and nothing is fitted.
    """
    x = whole_numbers(vectors, id_column, vector)
    distinct = written(x.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    if model is None:
        kind = x.schema["id"].dataType.simpleString()
        none = vectors.sparkSession.createDataFrame([], f"id {kind}, deviation bigint, whitened array<double>")
        return none, None, math.nan
    return apply(x, model), model, identity_error(distinct, model)
