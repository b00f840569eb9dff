"""Vectors of numbers as whole 256ths, packed into bytes so that equal vectors have equal bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import small_batches, written

SCALE = 256
#: Entries from here on (in 256ths) have no exact place in a long.
LARGEST = 2.0**62
#: Rows that are worked on at a time.
ROWS = 8192


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that count, the length of each, their entries as floor(256 * entry), a shorter vector ending in zeros).

    A null vector and one with a null or non-finite entry don't count.
    """
    counts = column.is_valid().to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[row[~np.isfinite(values)]] = False
    size = np.bincount(row, minlength=len(column))
    inside = counts[row]
    with np.errstate(over="ignore"):
        values = np.floor(values[inside] * SCALE)
    at, row = (np.arange(len(row)) - (np.cumsum(size) - size)[row])[inside], (np.cumsum(counts) - 1)[row[inside]]
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ArithmeticError("an entry is too large to be kept exactly")
    size = size[counts]
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    out[row, at] = values.astype(np.int64)
    return np.flatnonzero(counts), size, out


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the width of a number, then numbers of that width. Zeros at the end are left out and the width is the smallest, so equal vectors have equal bytes."""
    n, dims = x.shape
    used = x != 0
    size = np.where(used.any(axis=1), dims - np.argmax(used[:, ::-1], axis=1), 0) if dims else np.zeros(n, np.int64)
    top = np.where(x < 0, -(x + 1), x).max(axis=1) if dims else np.zeros(n, np.int64)
    width = np.select([top < 2**7, top < 2**15, top < 2**31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * n
    for w, s in {*zip(width.tolist(), size.tolist())}:
        rows = np.flatnonzero((width == w) & (size == s))
        data, head, step = x[rows, :s].astype(f"<i{w}").tobytes(), bytes([w]), w * s
        for k, row in enumerate(rows.tolist()):
            out[row] = head + data[k * step : (k + 1) * step]
    return out


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of packed() as a matrix of `dims` columns."""
    values = column.to_pylist()
    kinds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, v in enumerate(values):
        kinds[v[0], len(v)].append(k)
    out = np.zeros((len(values), dims), np.int64)
    for (w, length), rows in kinds.items():
        data = np.frombuffer(b"".join(values[k][1:] for k in rows), f"<i{w}")
        out[rows, : (length - 1) // w] = data.reshape(len(rows), (length - 1) // w)
    return out


def quantised(vectors: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """Written table (key, size, x, *others) of the rows whose vector counts: its length, and its whole 256ths packed.

    Later passes read one or two bytes an entry instead of the vectors.
    """
    small_batches(vectors.sparkSession)
    names = ["key", "size", "x", *(f"other{k}" for k in range(len(others)))]
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), *(F.col(c).alias(n) for c, n in zip(others, names[3:])))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows, size, x = whole(part.column("vector"))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column("key"), pa.array(size, pa.int32()), pa.array(packed(x), pa.binary()), *(taken.column(n) for n in names[3:])], names=names)

    fields = [StructField("key", LongType()), StructField("size", IntegerType()), StructField("x", BinaryType())]
    fields += [StructField(n, own.schema[n].dataType) for n in names[3:]]
    return written(own.mapInArrow(quantise, StructType(fields)), "vectors")


def dimensions(rows: DataFrame) -> int:
    return rows.agg(F.max("size")).first()[0] or 0


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, unpacked(part.column("x"), dims)


def summed(rows: DataFrame, dims: int, shape: tuple[int, int], term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of term(vectors), an array of doubles of that shape, over all rows: one array a task, merged on the executors in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in matrices(batches, dims):
            total += term(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    read = lambda row: np.frombuffer(row.total).reshape(shape)
    totals = rows.select("x").mapInArrow(partial, "total binary").rdd
    depth = 2 if totals.getNumPartitions() < 1000 else 3
    return totals.treeAggregate(np.zeros(shape), lambda a, row: a + read(row), lambda a, b: a + b, depth)
