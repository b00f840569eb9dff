"""Operator 11, embedding whitening: a covariance in two passes, its eigenvectors, and a broadcast projection.

Vectors are whole 256ths. The first pass sums them exactly, as integers, over each distinct vector; the
second sums the outer products of what is left after the mean is taken off, a matrix product a batch, and
merges one matrix a task in a tree. The mean's whole part is taken off in integers, so a large mean costs no
digits. The driver gets one matrix of dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .vectors import dimensions, matrices, quantised, summed

COMPONENTS = 4


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of vectors, sum of each dimension), exactly: partial sums of two halves of a number a task, then decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, [0] * dims, [0] * dims
        for _, x in matrices(batches, dims):
            n += len(x)
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist())]
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist())]
        totals = [Decimal(n), *(Decimal((b << 32) + a) for a, b in zip(low, high))]
        yield pa.RecordBatch.from_arrays([pa.array([totals], pa.list_(pa.decimal128(38, 0)))], names=["totals"])

    parts = fit.select("x").mapInArrow(partial, "totals array<decimal(38,0)>")
    place = parts.select(F.posexplode("totals").alias("place", "total")).groupBy("place").agg(F.sum("total").alias("total"))
    total = {r.place: int(r.total) for r in place.collect()}
    return total.get(0, 0), [total.get(k + 1, 0) for k in range(dims)]


class Centred:
    """Vectors less their mean S / n: the whole part of the mean in integers, then the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s - s // n * n, n)) for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, which of them aren't zero up to rounding), the largest first."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return values, vectors, values > len(covariance) * np.finfo(float).eps * max(values[0], 0.0) if len(values) else np.zeros(0, bool)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S) ** 2, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest**2 * max(1, len(sums)) < 2**63:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x.tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row whose vector counts and each component up to `components`.

    Rows with a null vector, or a null or non-finite entry, are dropped. A vector shorter than the longest
    ends in zeros; vectors without entries have no components. Equal vectors count once in the covariance
    and are each returned, repeated rows and null keys too. Fewer dimensions give fewer components. A
    component without variance (up to rounding; all of them where there is one distinct vector) has a null
    whitened and explains 0. An empty table gives no rows. Further columns are ignored. deviation is a
    decimal of 38 digits; entries of 2**54 or more raise an error rather than lose digits.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector)
    dims = dimensions(rows)
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], kinds)
    fit = written(rows.select("x").distinct(), "distinct")
    n, sums = exact_sums(fit, dims)
    centred = Centred(n, sums)

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    covariance = summed(fit, dims, (dims, dims), outer) / n
    values, axes, varies = principal(covariance, components)
    k, trace = len(values), float(np.trace(covariance))
    scaled = axes / np.sqrt(np.where(varies, values, np.inf))
    explained = np.where(varies, values, 0.0) / (trace or 1.0)
    projection = spark.sparkContext.broadcast((centred, scaled))

    def moments(x: np.ndarray) -> np.ndarray:
        center, axes = projection.value
        w = center(x) @ axes
        return np.vstack([w.sum(axis=0), w.T @ w])

    total = summed(fit, dims, (k + 1, k), moments) / n
    drop_written(fit)
    off = (total[1:] - np.outer(total[0], total[0]) - np.eye(k))[np.ix_(varies, varies)]
    error = float(np.abs(off).max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, axes = projection.value
        for part, x in matrices(batches, dims):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            w = pa.array((center(x) @ axes).ravel(), mask=~np.tile(varies, len(x)))
            columns = [
                part.column("key").take(each),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(k * len(x), n), pa.int64()),
                _deviations(x, n, sums).take(each),
                w,
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(k * len(x), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(project, kinds)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
