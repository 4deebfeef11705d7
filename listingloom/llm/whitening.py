"""Whitening of embeddings: the leading components of the distinct vectors' covariance, each row projected on them.

The covariance is summed where the rows are and only its d x d entries reach the driver, which finds the components (eigen)
and broadcasts d x k numbers for the projection. Entries are integers, so sums and products of them are exact and don't
depend on how rows were dealt out: a rerun gives the same components to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.llm import eigen
from listingloom.llm.vectors import finite, integers, matrix
from listingloom.session import materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: The driver holds a matrix of so many rows and columns at most: 32 MB.
MOST_DIMENSIONS = 2048
#: Components whose eigenvalue is below this share of the largest can't be told from rounding and are left out.
LEAST = 1e-10
_WHOLE = pa.decimal128(38, 0)
_SLICE = 4096


def _cells(values: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A matrix as rows (i, v), a few million entries at a time."""
    values = np.atleast_2d(values)
    step = max(1, (1 << 20) // max(1, values.shape[1]))
    for k in range(0, len(values), step):
        own = values[k : k + step]
        flat = pa.array(own.ravel().tolist() if own.dtype == object else own.ravel(), None if own.dtype != object else kind).cast(kind)
        ends = pa.array(np.arange(0, own.size + 1, values.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(own)), pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["i", "v"])


def _summed(rows: DataFrame, run: Callable, kind: str) -> list[list]:
    """The matrices of all tasks added up."""
    cells = rows.mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    return [[c.v for c in r.row] for r in sorted(found.collect(), key=lambda r: r.i)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of each dimension, then the number of vectors."""
    for batch in batches:
        for k in range(0, batch.num_rows, _SLICE):
            x = matrix(batch.column(0).slice(k, _SLICE))
            yield from _cells(np.append(x.sum(axis=0), len(x)), _WHOLE)


def _products(middle: np.ndarray) -> Callable:
    """The sums of (x_i - middle_i) * (x_j - middle_j), in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, room = None, 0.0
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                y = matrix(batch.column(0).slice(k, _SLICE)) - middle
                bound = float(np.abs(y).max()) ** 2 * len(y)
                if bound >= 2**53:  # too far out for doubles to hold the products
                    yield from _cells(y.astype(object).T @ y.astype(object), _WHOLE)
                    continue
                if room + bound >= 2**62:
                    yield from _cells(total, _WHOLE)
                    total, room = None, 0.0
                z = y.astype(np.float64)
                own = (z.T @ z).astype(np.int64)
                total, room = own if total is None else total + own, room + bound
        if total is not None:
            yield from _cells(total, _WHOLE)

    return run


class Whitening:
    """A fitted whitening: n and sums of the fit list, trace of its covariance, eigenvalues and unit components."""

    def __init__(self, n: int, sums: list[int], trace: float, values: np.ndarray, components: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.components = n, sums, trace, values, components
        self.middle = np.array([round_half(s, n) for s in sums], np.int64)
        #: What is left of the mean beyond the middle, times n.
        self.rest = [s - n * int(m) for s, m in zip(sums, self.middle, strict=True)]

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum)^2, exact; None where a long can't hold it."""
        y = x - self.middle
        most = self.n * (float(np.abs(y).max(initial=0)) + 1.0)
        if most**2 * y.shape[1] < 2**63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance (divisor n) of a table of distinct vectors x; None for an empty one.

    Two passes: sums, then products of entries centred by the rounded mean, exact integers; what rounding left of the mean
    is taken off in exact arithmetic, so each entry of the covariance is the true one rounded once.
    """
    found = _summed(fit_list, _sums, "decimal(38,0)")
    if not found:
        return None
    *sums, n = (int(v) for v in found[0])
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {len(sums)} entries; at most {MOST_DIMENSIONS} can be whitened")
    start = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    products = _summed(fit_list, _products(start.middle), "decimal(38,0)")
    covariance = np.array([[(n * int(v) - a * b) / (n * n) for v, b in zip(row, start.rest, strict=True)] for row, a in zip(products, start.rest, strict=True)])
    values, vectors = eigen.leading(covariance, components)
    real = values > LEAST * max(values[0], 0.0)
    return Whitening(n, sums, float(np.trace(covariance)), values[real], vectors[:, real])


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, summed over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                w = model.project(matrix(batch.column(0).slice(k, _SLICE)))
                total = total + w.T @ w
        if not isinstance(total, float):
            yield from _cells(total, pa.float64())

    found = np.array(_summed(fit_list, run, "double")) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row per vector and component.

    Rows count as `vectors.finite` says; entries c become floor(64 * c) + 1,000,000 (64 * c beyond +-2^40 counts as that).
    The components are fitted on each distinct vector once. Rows that repeat a key or a vector or have no key are projected
    like any other; other columns are ignored. There are fewer components than asked for where vectors have fewer dimensions
    or vary in fewer directions, so an empty table, or one whose vectors are all equal, gives no rows. deviation is null
    where a long can't hold it.
    """
    spark = vectors.sparkSession
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, deviation long, whitened array<double>"
    kept = finite(vectors.select(key, column), column).select(key, integers(column, SCALE, SHIFT).alias("x"))
    fit_list = materialize(kept.select("x").distinct(), "fit-list")
    model = fit(fit_list, components)
    if model is None or not len(model.values):
        out = spark.createDataFrame([], schema).select(key, F.posexplode("whitened").alias("component", "whitened"), "deviation")
        n, explained, error = 0, [0.0], 0.0
    else:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                if len(x):
                    w = shared.value.project(x)
                    ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                    whitened = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.deviation(x), pa.int64()), whitened], [key, "deviation", "whitened"])

        out = kept.mapInArrow(run, schema).select(key, F.posexplode("whitened").alias("component", "whitened"), "deviation")
        n, explained, error = model.n, (model.values / model.trace).tolist(), identity_error(fit_list, model)
    share = F.element_at(F.array(*(F.lit(v) for v in explained)), F.col("component") + 1)
    return out.select(key, (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
