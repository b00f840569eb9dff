"""Operator 12, vector code compression: parts of vectors named by the nearest entry of a codebook.

The nearest entry is screened by a float32 matrix product: each distance gets an interval that its rounding
errors can't leave, and the entries whose interval overlaps the best one are evaluated again in integers;
equal distances go to the smaller index. So codes are exact, and nearly all distances cost one product.
Codebooks are learned in rounds: a task sums its parts by entry, the sums are added up by (part, entry), and
the driver gets one number an entry and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table, written
from .vectors import dimensions, matrices, quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rounding error of a float32 operation.
UNIT = 2.0**-24


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exactly: in int64 where it holds them, else in Python's integers."""
    largest = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if largest**2 * max(1, x.shape[1]) < 2**63:
        return ((x - c) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def screened(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest of each row: those whose interval overlaps the best.

    What is compared is |c|^2 - 2 x.c. With p terms, the product's rounding is at most p units of |x||c|,
    whatever its order of adding (and |x||c| bounds the sum of absolute products); numbers put into float32 add two, the square's rounding and the
    subtraction two more of the whole. 8 instead of those, and a hundredth on top, cover second-order terms
    and the rounding of the bound. What overflows is never screened out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        square = (entries.astype(np.float64) ** 2).sum(axis=1)
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        score = (square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)).astype(np.float64)
        slack = 1.01 * (x.shape[1] + 8) * UNIT * (2 * np.outer(length, np.sqrt(square)) + square)
        best = (score + slack).min(axis=1, keepdims=True)
        return ~(score - slack > best)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each row; ties go to the smaller index."""
    possible = screened(x, entries)
    index = possible.argmax(axis=1)
    unsure = np.flatnonzero(possible.sum(axis=1) > 1)
    if len(unsure):
        row, entry = np.nonzero(possible[unsure])
        d = distances(x[unsure[row]], entries[entry])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        closest = np.minimum.reduceat(d, first)
        index[unsure] = np.minimum.reduceat(np.where(d == closest[row], entry, len(entries)), first)
    return index, distances(x, entries[index])


def _learned(rows: DataFrame, dims: int, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean, rounded down, of the parts that are nearest to it; unused ones stay."""
    parts, entries, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, size), object)
        for _, x in matrices(batches, dims):
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                index, _ = nearest(own, books[p])
                count[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                wide = own[order] if np.abs(own).max(initial=0) < 2**48 else own[order].astype(object)
                total[p, used] += np.add.reduceat(wide, first, axis=0)
        p, e = np.nonzero(count)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array([list(map(int, t)) for t in total[p, e]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "totals"])

    place = rows.select("x").mapInArrow(sums, "part int, entry int, n long, totals array<long>").select("part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    added = place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.copy()
    for r in added.collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The entries as (part, entry, dimension): first the parts of the rows with the smallest keys (null ones last, equal ones by their vectors), then learned."""
    first = rows.orderBy(F.col("key").asc_nulls_last(), "size", "x").limit(entries).select("x").toArrow()
    size = -(-dims // parts)
    start = next(iter(matrices(first.combine_chunks().to_batches(), parts * size)))[1]
    books = start.reshape(len(start), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _learned(rows, parts * size, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector counts.

    Rows with a null vector, or a null or non-finite entry, are dropped. A vector ends in zeros up to the
    longest one's length, rounded up to a multiple of the parts; where all are empty, no part has an
    entry's dimension and every code is 0. Repeated rows and keys are rows of their own, also among the
    first entries; fewer rows than entries give smaller codebooks. Null labels are one label, null keys
    come last. An empty table gives no rows. Further columns are ignored. Entries of 2**54 or more and
    errors beyond a long raise an error.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, label)
    longest = rows.agg(F.max("size")).first()[0]
    kind = rows.schema["other0"].dataType
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = codebooks(rows, dimensions(rows) or 1, parts, entries, rounds)
    size = books.shape[2]
    shared = spark.sparkContext.broadcast(books)
    names = ["key", "label", "code", "error"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for part, x in matrices(batches, parts * size):
            code = np.zeros((len(x), parts), np.uint8)
            error = np.zeros(len(x), object)
            for p in range(parts):
                code[:, p], d = nearest(x[:, p * size : (p + 1) * size], books[p])
                error += d
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("other0"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(list(map(int, error)), pa.int64())], names=names)

    schema = StructType([StructField("key", LongType()), StructField("label", kind), StructField("code", StringType()), StructField("error", LongType())])
    coded = written(rows.mapInArrow(encode, schema), "codes")
    by_label = coded.groupBy(F.col("label").alias("own_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
