"""Whitening of embeddings by their exact mean and a two-pass covariance.

Entries become whole numbers first, so a mean is an exact sum over a count. The covariance is fitted on each distinct
vector once: a first pass sums integers, a second sums outer products of the centred rows as matrix products of a few
thousand rows at a time, and partial sums of the tasks are merged by a tree. The symmetric eigenproblem is solved by
LAPACK at the driver, and the projection goes to every task. A third pass of the second's kind measures how far the
whitened rows are from unit covariance.

The driver and each task hold matrices of dimension by dimension, whatever the number of rows; ``most_dims`` bounds it.
Vectors of another length are a space of their own, with their own n, mean and components. Rows whose vector is null or
has null or non-finite entries are dropped; a vector of no entries has no components; repeated ids and rows give a row each.
Entries beyond 2^53 / 64 count as that bound. A component without variance has null ``whitened`` and stays out of
``identity_error``; where the deviation passes 64 bits it is null, and ``deviation_digits`` holds it at any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

_LOW = (1 << 31) - 1
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def _whole(v: Column, scale: int, shift: int) -> Column:
    """The vector in whole numbers; null if it is null or holds null or non-finite entries."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    edge = float(1 << 53)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(edge)), F.lit(-edge))).cast("long") + shift)
    return F.when(v.isNotNull() & ~bad, x)


def _matrices(column: pa.Array, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length at a time: their places in the batch and their entries."""
    sizes = np.diff(column.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        same = np.flatnonzero(sizes == d)
        for i in range(0, len(same), rows):
            part = same[i : i + rows]
            yield part, flat[at[part][:, None] + np.arange(d)]


def _merged(rows: DataFrame, one: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vector: number of rows and sum of ``one`` over them, partial in each task and merged by a tree."""

    def add(a: dict, b: dict) -> dict:
        for d, (n, total) in b.items():
            a[d] = (a[d][0] + n, a[d][1] + total) if d in a else (n, total)
        return a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part, x in _matrices(batch.column(0)):
                add(held, {x.shape[1]: (len(part), one(x))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["held"])

    return rows.mapInArrow(run, "held binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate({}, add, add)


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers: high and low halves add up without overflow."""
    return (x >> 31).sum(0).astype(object) * (_LOW + 1) + (x & _LOW).sum(0).astype(object)


class Fit:
    """Mean, components and their checks for vectors of one length."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        self.basis = np.zeros((len(sums), 0))
        self.explained, self.usable, self.identity_error = [], np.zeros(0, bool), 0.0

    def solve(self, outer: np.ndarray, most: int) -> None:
        """Components of the covariance by falling eigenvalue; the largest entry of each is positive."""
        cov = outer / self.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        trace = float(np.trace(cov))
        self.usable = values > max(trace, 0) * len(cov) * np.finfo(float).eps
        self.explained = [float(v) / trace if trace > 0 else None for v in values]
        self.basis = np.divide(vectors, np.sqrt(np.where(self.usable, values, 1)), where=self.usable, out=np.zeros_like(vectors))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact: in 64 bits where they hold it, in Python's integers elsewhere."""
        top = max(int(abs(x).max()), 1) * self.n + max(abs(s) for s in self.sums)
        if top < 1 << 62:
            away = x * self.n - self.sums.astype(np.int64)
            if len(self.sums) * int(abs(away).max()) ** 2 < 1 << 63:
                return (away * away).sum(1).tolist()
        away = x.astype(object) * self.n - self.sums
        return (away * away).sum(1).tolist()


def fit(vectors: DataFrame, components: int = 16, most_dims: int = 8192) -> dict[int, Fit]:
    """A fit for each length of the distinct vectors in ``vectors(x)``."""
    fits = {d: Fit(n, s) for d, (n, s) in _merged(vectors, _exact_sum).items()}
    if fits and max(fits) > most_dims:
        raise ValueError(f"vectors of {max(fits)} entries; a covariance of at most {most_dims} fits the driver")

    def outer(x: np.ndarray) -> np.ndarray:
        away = x - means[x.shape[1]]
        return away.T @ away

    def spread(x: np.ndarray) -> np.ndarray:
        w = solved.value[x.shape[1]].whitened(x)
        return np.concatenate([w.T @ w, w.sum(0)[None, :]])

    means = {d: f.mean for d, f in fits.items()}
    for d, (_, total) in _merged(vectors, outer).items():
        fits[d].solve(total, components)
    solved = vectors.sparkSession.sparkContext.broadcast(fits)
    for d, (n, total) in _merged(vectors, spread).items():
        centre = total[-1] / n
        off = np.abs(total[:-1] / n - np.outer(centre, centre) - np.eye(len(centre)))[np.ix_(fits[d].usable, fits[d].usable)]
        fits[d].identity_error = float(off.max()) if off.size else 0.0
    return fits


def _projected(shared):
    """Rows (id, x) -> a row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch.column(1), 1024):
                f = shared.value[x.shape[1]]
                rows, k = x.shape[0], f.basis.shape[1]
                w = f.whitened(x).ravel()
                exact = np.repeat(np.array(f.deviation(x), object), k).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(part, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, f.n)),
                        pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), pa.array(w, mask=~np.tile(f.usable, rows)),
                        pa.array(f.explained * rows, pa.float64()), pa.array(np.full(rows * k, f.identity_error)), pa.array([str(v) for v in exact]),
                    ],
                    names=[c.split()[0] for c in _OUT.split(", ")],
                )

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000, most_dims: int = 8192) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits)`` for each vector and component.

    x is the whole part of ``scale`` times an entry, plus ``shift``; n counts distinct x vectors, deviation is the sum of (n x - S)^2, whitened the centred
    row projected on a unit eigenvector and divided by the root of its eigenvalue, explained that eigenvalue's share of the trace.
    """
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), _whole(F.col(vector_col), scale, shift).alias("x")).where("x is not null")
    distinct = materialize(whole.select("x").distinct(), "zstd")
    fits = fit(distinct, components, most_dims)
    return whole.mapInArrow(_projected(rows.sparkSession.sparkContext.broadcast(fits)), _OUT)
