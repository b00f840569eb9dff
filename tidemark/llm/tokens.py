"""Token ids of whole texts, by the tokenizers library, as a written table."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .hashed_words import lots, span_hashes, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: The blanks that part chunks. The tokenizer's own split always starts a piece where a run of blanks starts, so a chunk, a run of blanks and the word after it, can be encoded by itself.
BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
#: Other white space, which could join a run of blanks; a text with any is one chunk. So is one with a string that the tokenizer takes for a special token.
OTHER_BLANKS = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Chunks whose ids are kept, and ids kept, at most.
KEPT, KEPT_IDS = 1_000_000, 6_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A chunk that is a word, and stops or commas. The tokenizer's split never joins these with a letter, so both parts can be encoded by themselves.
WORD_AND_STOP = re.compile(rb"([ ]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]*)")


class Encoder:
    """Encodes texts to ids. The ids of chunks met are kept in arrays, in order of the chunks' 64-bit hashes."""

    def __init__(self, path: str, kept: int = KEPT, kept_ids: int = KEPT_IDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.type = vocabulary(path)[1]
        self.split, self.no_split = self.tokenizer.pre_tokenizer, ByteLevel(add_prefix_space=False, use_regex=False)
        self.odd = "|".join([OTHER_BLANKS, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.kept, self.kept_ids = kept, kept_ids
        self._forget()

        self.again = self.hashes[:0].astype(bool)

    def _forget(self) -> None:
        self.hashes, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, self.type)

    def _make_room(self) -> None:
        """Where too much is kept: keeps the chunks that were met in more than one lot; none if these are most."""
        if len(self.hashes) <= self.kept and len(self.pool) <= self.kept_ids:
            return
        own = np.flatnonzero(self.again)
        count = self.count[own]
        if len(own) > self.kept // 2 or count.sum() > self.kept_ids // 2:
            own, count = own[:0], count[:0]
        ends = np.cumsum(count, dtype=np.int32)
        self.pool = self.pool[np.repeat(self.first[own] - (ends - count), count) + np.arange(count.sum(), dtype=np.int32)]
        self.hashes, self.first, self.count = self.hashes[own], ends - count, count
        self.again = np.zeros(len(own), bool)

    def _encoded(self, chunks: list[bytes], whole: bool = False) -> list[list[int]]:
        """Ids of chunks; whole: of words, which the tokenizer's split would leave whole, so it is skipped."""
        self.tokenizer.pre_tokenizer = self.no_split if whole else self.split
        return [x.ids for x in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)] if chunks else []

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are, or would be, and whether they are there."""
        at = np.searchsorted(self.hashes, hashes)
        return at, self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Adds different chunks, their hashes in order, that aren't there."""
        parts = [m.groups() if (m := WORD_AND_STOP.fullmatch(c)) else (None, c) for c in chunks]
        # A word that stands before a stop here may have been met without one.
        words = list({w for w, s in parts if w is not None})
        own = span_hashes(np.frombuffer(b"".join(words), np.uint8), *((ends := np.cumsum([len(w) for w in words])) - [len(w) for w in words], ends)) if words else np.empty(0, np.uint64)
        at, there = self._places(own)
        ids = {w: self.pool[self.first[k] : self.first[k] + self.count[k]].tolist() for w, k, t in zip(words, at.tolist(), there.tolist()) if t}
        new = [w for w in words if w not in ids]
        ids |= zip(new, self._encoded(new, True))
        rest = list({s for _, s in parts if s})
        other = dict(zip(rest, self._encoded(rest)))
        found = [ids[w] + (other[s] if s else []) if w is not None else other[s] for w, s in parts]
        count = np.fromiter(map(len, found), np.int32, len(found))
        at = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, at, len(self.pool) + np.cumsum(count, dtype=np.int32) - count)
        self.again = np.insert(self.again, at, False)
        self.count, self.hashes = np.insert(self.count, at, count), np.insert(self.hashes, at, hashes)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), self.type, int(count.sum()))])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, the number of each text's); none for a null or empty text.

        Chunks are found by place in the texts' bytes and told apart by hash; each different one is looked
        up once, and its ids are copied to all its places by numpy.
        """
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), self.odd), False).to_numpy(zero_copy_only=False))
        data, bounds = text_bytes(texts)
        if not len(data):
            return np.empty(0, self.type), np.zeros(len(texts), np.int64)
        blank = BLANK[data]
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        for d in odd:
            starts[bounds[d] : bounds[d + 1]] = False
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(data))
        hashes, where, code = np.unique(span_hashes(data, at, ends), return_index=True, return_inverse=True)
        self._make_room()
        own, there = self._places(hashes)
        self.again[own[there]] = True
        if not there.all():
            whole = data.tobytes()
            self._learn(hashes[~there], [whole[a:b] for a, b in zip(at[where[~there]].tolist(), ends[where[~there]].tolist())])
        own, _ = self._places(hashes)
        first, each = self.first[own][code], self.count[own][code]
        done = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        place = np.repeat(first - done[:-1].astype(np.int32), each)
        place += np.arange(done[-1], dtype=np.int32)
        return self.pool[place], np.diff(done[np.searchsorted(at, bounds)])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@lru_cache(maxsize=None)
def vocabulary(path: str) -> tuple[int, np.dtype]:
    """(size, type of an id) of a vocabulary. Asked on the driver, so that only tasks that encode load the tokenizer."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    return size, np.dtype("<u2") if size <= 65536 else np.dtype("<u4")


def token_table(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """Written table (doc_id, part, part_start, n_tokens, ids): the ids of each text and the end id, packed.

    part is the writing task, part_start the ids of that task before the row. A null text is empty, so
    its row holds the end id alone. Repeated rows are rows of their own. No shuffle; one pass over the texts.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for lot in lots(batches):
            ids, counts = encode_text.ids(lot.column("text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.concatenate([[0], np.cumsum(counts)])
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([lot.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends[:-1]), pa.array(counts), packed], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(encode, "doc_id long, part int, part_start long, n_tokens long, ids binary"), "tokens", "zstd")


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """First pass of the prefix sum: ids before each part. One number a task, so its size is the number of partitions."""
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = {}, 0
    for part, n in totals:
        offsets[part] = before
        before += n
    return offsets
