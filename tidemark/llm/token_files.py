"""Operator 7, token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format, all numbers little-endian. A file holds documents in ascending order of doc_id:

    8 bytes   magic b"TIDEIDS1"
    8 bytes   n_docs, 8 bytes n_ids, 8 bytes n_data
    n_docs * 8 bytes  doc_id (a null key: -2**63)
    n_docs * 8 bytes  number of ids of each document
    ceil(n_ids / 4)   control bytes: two bits an id, the lowest first: bytes of its rank, less one
    n_data            the ranks' bytes, lowest first, without gaps

Beside the files lies the table of ranks: the id of each rank, most frequent first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written
from .hashed_words import text_bytes
from .tokens import token_table, vocabulary, vocabulary_path

MAGIC = b"TIDEIDS1"
END_ID = 0
#: Ids of one file at most, unless a single document has more.
FILE_IDS = 2_000_000
NULL_KEY = -(2**63)
PREFIX = "ids-"

#: For each control byte: the bytes of its four ranks.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    n = len(ranks)
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks: lengths by a table lookup of each control byte, then the data gathered by place."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    place = np.cumsum(size) - size
    held = np.frombuffer(data, np.uint8)
    out = held[place].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= held[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(keys: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join((MAGIC, np.asarray([len(keys), len(ranks), len(data)], "<i8").tobytes(), np.asarray(keys, "<i8").tobytes(), np.asarray(counts, "<i8").tobytes(), control, data))


def parse_file(content: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, ranks) of a file; ValueError if it isn't one or is cut short."""
    content = memoryview(content)
    if content[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, n_data = np.frombuffer(content, "<i8", 3, 8)
    at = 32 + 16 * docs
    end = at + -(-n // 4) + n_data
    if len(content) != end:
        raise ValueError(f"{len(content)} bytes where {end} were written")
    keys, counts = np.frombuffer(content, "<i8", docs, 32), np.frombuffer(content, "<i8", docs, 32 + 8 * docs)
    return keys, counts, decode_ranks(content[at : at + -(-n // 4)], content[at + -(-n // 4) : end], int(n))


def rank_table(tokens: DataFrame, path: str) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id. Each task sums its own counts; the result has one entry an id of the vocabulary."""
    size, kind = vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            total += np.bincount(data.view(kind) if data.ctypes.data % kind.itemsize == 0 else np.frombuffer(data.tobytes(), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in rows:
        total[r.id] = r.n
    return np.lexsort((np.arange(size), -total)).astype(np.uint32)


@dataclass
class TokenFiles:
    """What reading needs beside the folder: a row a task that wrote (part, attempt, n_ids, first_key), and the ids by rank."""

    table: DataFrame
    by_rank: np.ndarray

    def offsets(self) -> dict[int, tuple[int, int]]:
        """(attempt, ids before its first file) of each part. One entry a task, so the driver's share doesn't grow with rows or files."""
        out, before = {}, 0
        for r in sorted(self.table.select("part", "attempt", "n_ids").collect()):
            out[r.part] = r.attempt, before
            before += r.n_ids
        return out


def write_files(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None, file_ids: int = FILE_IDS) -> TokenFiles:
    """Writes the documents' ids under `folder`.

    A file's name holds its part, its number, the part's ids before it, and the attempt that wrote it. The table
    names the attempts that succeeded: a lost executor leaves at most files of an attempt that it doesn't name.
    Documents are dealt by ranges of doc_id, then of their place in the table of tokens, so that rows without
    a key, or of one key, are spread too; a file is closed at `file_ids`. Null keys come first; rows that
    share a key keep the order in which they were encoded.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    tokens = token_table(docs, end_id, path)
    by_rank = rank_table(tokens, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "part", "part_start"]
    kind = vocabulary(path)[1]
    ordered = tokens.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "part", "part_start", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.empty(len(by_rank), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        keys: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []
        first_key, files, before, size = None, 0, 0, 0

        def close() -> None:
            with system.open_output_stream(f"{base}/{PREFIX}{part}-{files}-{before}-{attempt}.bin") as out:
                out.write(file_bytes(keys, counts, rank[np.frombuffer(b"".join(held), kind)]))
            keys.clear(), counts.clear(), held.clear()

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(ids) // kind.itemsize
                if counts and size + n > file_ids:
                    close()
                    files, before, size = files + 1, before + size, 0
                first_key = key if first_key is None else first_key
                keys.append(key), counts.append(n), held.append(ids)
                size += n
        if counts:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, attempt, before + size, first_key)], names=["part", "attempt", "n_ids", "first_key"])

    return TokenFiles(written(ordered.mapInArrow(write, "part long, attempt long, n_ids long, first_key long"), "files"), by_rank)


def read_files(spark: SparkSession, folder: str, files: TokenFiles, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the files of the attempts that succeeded; ids unsigned, 32 bits, packed. With digest, their crc32 (ids_crc32) in place of ids."""
    last = "ids_crc32 long" if digest else "ids binary"
    small_batches(spark)
    offsets, by_rank = files.offsets(), files.by_rank

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, _, before, attempt = map(int, where.rpartition("/")[2].removeprefix(PREFIX).removesuffix(".bin").split("-"))
                if part not in offsets or offsets[part][0] != attempt:
                    continue
                keys, counts, ranks = parse_file(content.as_buffer())
                ids = by_rank[ranks]
                ends = np.cumsum(counts)
                for lo in range(0, len(keys), 500):
                    own = slice(lo, lo + 500)
                    first = int(ends[lo] - counts[lo])
                    at = np.append(ends[own] - counts[own], ends[own][-1]) - first
                    flat = ids[first : first + at[-1]].astype("<u4")
                    packed = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()) if digest else pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[own], mask=keys[own] == NULL_KEY), pa.array(offsets[part][1] + before + ends[own] - counts[own]), pa.array(counts[own]), packed], names=["doc_id", "start", "n_tokens", last.split()[0]]
                    )

    if not offsets:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {last}")
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last}")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    return read_files(spark, folder, write_files(table(spark, sf_dir, "documents"), folder), digest=True)
