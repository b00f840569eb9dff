"""Words of many texts as arrays of 64-bit hashes, and packed rows of hashed places that tasks exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(2**64 - 1)
#: A null key sorts first.
NULL_KEY = -(2**63)
#: Bytes of text that a task looks at together. A longer text is looked at by itself.
LOT = 2_000_000
#: Bytes that are hashed at a time, unless a word is longer.
PIECE = 1 << 18
#: The bytes that part words: \x20 and \x09-\x0D, as in bytes.split().
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes as they are, and with A-Z in lower case.
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = np.frombuffer(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), np.uint8)

BYTE_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BYTE_BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BYTE_BASE, pow(BYTE_BASE, -1, 2**64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the bytes, by differences of one running sum: equal bytes have equal hashes wherever they stand. Spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        s, e = starts[i:j] - first, ends[i:j] - first
        power, inverse = _power(int(e[-1]))
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((data[first : first + int(e[-1])].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * BASE)
        i = j
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, where each text starts and the last ends); a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of some texts in a row: hashes, the number of each text's (sizes), the first of each (starts), and each word's text (doc)."""

    def __init__(self, texts: pa.Array, table: np.ndarray = AS_IS):
        data, bounds = text_bytes(texts)
        data = data if table is AS_IS else table[data]
        inside = ~BLANK[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        begin = np.flatnonzero(first)
        self.hashes = span_hashes(data, begin, np.flatnonzero(last) + 1)
        at = np.searchsorted(begin, bounds)
        self.starts, self.sizes = at[:-1], np.diff(at)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)


def hash_word(word: bytes) -> int:
    return int(span_hashes(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words: a polynomial put together from runs of powers of two, then mixed."""
    out, done = None, 0
    power, run, width = BASE, words, 1
    while True:
        if size & width:
            if out is None:
                out, done = run, width
            else:  # the run done so far, then the next `width` words
                n = len(words) - done - width + 1
                out = out[: max(n, 0)] * power + run[done : done + max(n, 0)]
                done += width
        if done == size:
            return mix(out)
        run = run[:-width] * power + run[width:] if len(run) > width else run[:0]
        power, width = np.uint64(int(power) ** 2 % 2**64), width * 2


def sliding_min(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size`."""
    out, width = a, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = size - width
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def key_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed value; the first as it is, the others as differences, which are small in order."""
    parts = [np.ascontiguousarray(columns[0]).tobytes()]
    for c in columns[1:]:
        c = c.astype(np.int64)
        parts.append(np.diff(c, prepend=np.int64(0)).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join(parts))


def unpack(value: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:8], "little")
    out = [np.frombuffer(raw, np.uint64, n, 8)]
    for k in range(1, columns):
        out.append(np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 8 * n * k)))
    return out


def deal(bucket: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) for each bucket that has rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        yield int(b), pack(*(c[own] for c in columns))


def lots(batches: Iterator[pa.RecordBatch], limit: int = LOT, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in lots of about `limit` bytes of text. One text more than that is a lot of its own, or ends one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, lo, before = np.cumsum(sizes), 0, 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, int(np.searchsorted(total, before + limit - size)) + 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(total[hi - 1]) - before
            lo, before = hi, int(total[hi - 1])
            if size >= limit:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def column_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers as an array of its own."""
    return batch.column(name).to_numpy(zero_copy_only=False).copy()
