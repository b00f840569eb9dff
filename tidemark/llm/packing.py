"""Operator 2, packing: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import part_offsets, token_table, vocabulary, vocabulary_path

SEQUENCE = 2048
END_ID = 1
PLACE = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]


def _crc(ids: bytes, kind: np.dtype) -> int:
    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4"))


def pack(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, path: str | None = None, digest: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents, cut at fixed windows. With digest, the crc32 of the ids as little-endian unsigned 32-bit integers (ids_crc32) in place of ids.

    Two passes: the texts are encoded once into a written table whose rows know the ids before them in
    their part; the totals of the parts (one number a task) become global offsets; then every row is cut
    where its place in the concatenation crosses a multiple of `length`. The second pass is a map without
    a shuffle. Only the last sequence can be short. A null or empty text is the end id alone; repeated
    rows are packed each; an empty table gives no piece; further columns are ignored.
    """
    path = path or vocabulary_path()
    tokens = token_table(docs, end_id, path)
    offsets = part_offsets(tokens)

    kind = vocabulary(path)[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, part, start, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                place, done = offsets[part] + start, 0
                while done < n:
                    sequence, at = divmod(place + done, length)
                    take = min(length - at, n - done)
                    own = ids[done * kind.itemsize : (done + take) * kind.itemsize]
                    for column, value in zip(out, (doc, done, take, n, sequence, at, _crc(own, kind) if digest else own)):
                        column.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:6]] + [pa.array(out[6], pa.int64() if digest else pa.binary())], names=[*PLACE, "ids_crc32" if digest else "ids"])

    kinds = ", ".join(f"{c} long" for c in PLACE) + (", ids_crc32 long" if digest else ", ids binary")
    return tokens.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(cut, kinds)


def sequences(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the packed sequences.

    A task joins the pieces it holds; a window that it holds in full is done there. Parts of windows at its
    edges become boundary records, and only those are shuffled, by sequence_id, and joined in order of offset.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, count = None, 0, [], 0

        def record():
            return [at], [first], [count], [b"".join(held)]

        out: list[list] = [[], [], [], []]
        for batch in batches:
            for sequence, offset, n, ids in zip(*(batch.column(k).to_pylist() for k in ("sequence_id", "offset", "length", "ids"))):
                if at is not None and (sequence != at or offset != first + count):
                    for column, value in zip(out, record()):
                        column += value
                    at = None
                if at is None:
                    at, first, held, count = sequence, offset, [], 0
                held.append(ids)
                count += n
            if len(out[0]) > 500:
                yield _records(out)
                out = [[], [], [], []]
        if at is not None:
            for column, value in zip(out, record()):
                column += value
        yield _records(out)

    def _records(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.binary())], names=["sequence_id", "offset", "n_tokens", "ids"])

    records = pieces.select("sequence_id", "offset", "length", "ids").mapInArrow(join, "sequence_id long, offset long, n_tokens long, ids binary")
    whole = records.where(F.col("n_tokens") == length).select("sequence_id", "n_tokens", "ids")
    edges = records.where(F.col("n_tokens") < length).groupBy("sequence_id").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = edges.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return whole.unionByName(joined)


def digests(rows: DataFrame, keep: list[str], name: str, path: str | None = None) -> DataFrame:
    """The rows' columns `keep` (long) and `name`, the crc32 of their ids as little-endian unsigned 32-bit integers."""
    kind = vocabulary(path or vocabulary_path())[1]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([_crc(x, kind) for x in batch.column("ids").to_pylist()], pa.int64())], names=[*keep, name])

    return rows.select(*keep, "ids").mapInArrow(digest, ", ".join(f"{k} long" for k in [*keep, name]))


def with_sequence_digest(pieces: DataFrame, length: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids, and sequence_crc32, that of all ids of a piece's sequence. Only digests are shuffled, and the boundary records."""
    pieces = written(pieces, "pieces", "zstd")
    return digests(pieces, PLACE, "ids_crc32", path).join(digests(sequences(pieces, length), ["sequence_id"], "sequence_crc32", path), "sequence_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
