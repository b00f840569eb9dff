"""Operator 8, substring dedup: relative Lempel-Ziv parsing against an index of all documents.

The reference is the whole corpus. Its index, the hash of each window (20 words) with the place where it
occurs first, is dealt into blocks by hash, so that every document is looked up in every block without
comparing documents with documents. A document is parsed greedily: at the first window that the reference
holds at an earlier place a factor begins, which is extended as long as the next window's place follows in
the same source. Where it ends the next factor begins, which may overlap it: windows over the boundary of
two factors are looked up by themselves, so none is lost. Each factor is then compared word by word with
its source's text, and what differs (equal hashes of different words) is dropped. Factors have a window's
words at least; they are the duplicate spans.

Looking up each window would move each window. So a sample comes first: a window's anchor is the smallest
hash of its runs of 10 words, equal windows have equal anchors, and one word in six starts an anchor.
Only windows whose anchor occurs twice in the corpus can be duplicates and are looked up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .hashed_words import NULL_KEY, TOP, Words, column_of, deal, key_column, lots, mix, rolling, sliding_min, text_column, unpack

WINDOW, ANCHOR = 20, 10


class Lot:
    """The words of some documents in a row, with the anchors of their windows."""

    def __init__(self, words: Words, window: int, anchor: int):
        self.sizes, self.starts, self.doc, self.words = words.sizes, words.starts, words.doc, words.hashes
        self.place = np.arange(len(self.words)) - self.starts[self.doc]
        self.window = window
        self.span = window - anchor + 1
        self.grams = self.hashed(anchor) if len(self.words) >= anchor else np.empty(0, np.uint64)
        self.least = sliding_min(self.grams, self.span)  # a window's anchor hash
        inside = self.place + window <= self.sizes[self.doc]
        self.whole = inside[: len(self.least)]  # the window doesn't run into the next document

    def hashed(self, anchor: int) -> np.ndarray:
        return mix(rolling(self.words, anchor) ^ np.uint64(0xA5A5))

    def anchors(self) -> np.ndarray:
        """Where the anchors of whole windows start."""
        if not len(self.least):
            return np.empty(0, np.int64)
        # TOP - x turns the largest of the windows' anchors over a place into a smallest.
        flipped = np.where(self.whole, TOP - self.least, TOP)
        padded = np.concatenate([np.full(self.span - 1, TOP), flipped, np.full(self.span - 1, TOP)])
        best = sliding_min(padded, self.span)[: len(self.grams)]
        return np.flatnonzero((TOP - best == self.grams) & (best != TOP))

    def windows_with(self, flagged: np.ndarray) -> np.ndarray:
        """Whole windows whose anchor is among the flagged places."""
        if not len(self.least):
            return np.empty(0, np.int64)
        marked = np.where(flagged[: len(self.grams)], self.grams, TOP)
        return np.flatnonzero(self.whole & (sliding_min(marked, self.span) == self.least))


def _grouped(h: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, then by place; the first of each row's group in that order, and whether a row stands at another place than it."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    group = np.cumsum(new)
    # Few hashes stand at several places: only those are put in order by place.
    several = np.flatnonzero(np.bincount(group)[group] > 1) if len(s) else np.empty(0, np.int64)
    own = order[several]
    order[several] = own[np.lexsort((*(c[own] for c in reversed(place)), group[several]))]
    first = order[np.flatnonzero(new)[group - 1]]
    return order, first, np.logical_or.reduce([c[order] != c[first] for c in place])


def squeezed(places: np.ndarray) -> bytes:
    """Ascending places as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(places, prepend=0).astype("<u4").tobytes())


def unsqueezed(value: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(value), "<u4").astype(np.int64))


def _new(columns: list[np.ndarray]) -> np.ndarray:
    """Rows, in order, that differ from the one before."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.empty(0, bool)


def _flagged_places(rows: list[np.ndarray]) -> pa.RecordBatch:
    """One row a document: (key, tag, its places, each once)."""
    order = np.lexsort(rows[::-1])
    key, tag, place = (c[order] for c in rows)
    once = _new([key, tag, place])
    key, tag, place = key[once], tag[once], place[once]
    first = np.flatnonzero(_new([key, tag]))
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(tag[first]), pa.array([squeezed(x) for x in np.split(place, first[1:])] if len(first) else [], pa.binary())], names=["key", "tag", "places"])


FACTOR = ("key", "tag", "start", "size", "source_key", "source_tag", "source_start")


def parsed(rows: list[np.ndarray], window: int) -> list[np.ndarray]:
    """Factors (FACTOR's columns) of documents from their flagged windows (key, tag, place, and the place of the source): each maximal run of windows whose sources follow each other.

    A window that was looked up twice keeps its earliest source. A factor's size is in words.
    """
    order = np.lexsort(rows[::-1])
    rows = [c[order] for c in rows]
    once = _new(rows[:3])
    key, tag, place, *source = (c[once] for c in rows)
    follows = np.zeros(len(key), bool)
    if len(key):
        follows[1:] = ~_new([key, tag, *source[:2]])[1:] & (np.diff(place) == 1) & (np.diff(source[2]) == 1)
    first = np.flatnonzero(~follows)
    size = np.diff(np.append(first, len(key))) + window - 1
    return [key[first], tag[first], place[first], size, *(c[first] for c in source)]


def _lookup(dealt: DataFrame, parts: int, columns: int, look, merge, schema: str) -> DataFrame:
    """merge()'s rows of the places that index blocks flag. dealt: (block, known, packed).

    What isn't known yet is packed (hash, key, tag, place) and goes through look(), which gives `columns` columns for
    the flagged ones; what is known already has those columns. A block sends its flags on by document in one row a
    destination, so the rows exchanged don't grow with the documents times the blocks.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[list[np.ndarray]] = []
        flagged: list[list[np.ndarray]] = []
        for batch in batches:
            for known, value in zip(batch.column("known").to_pylist(), batch.column("packed").to_pylist()):
                flagged.append(unpack(value, columns)) if known else new.append(unpack(value, 4))
        if new:
            rows = [np.concatenate(c) for c in zip(*new)]
            new.clear()
            flagged.append(look(*rows))
        if flagged:
            rows = [np.concatenate([f[k].astype(np.int64) for f in flagged]) for k in range(columns)]
            flagged.clear()
            order = np.lexsort(rows[2::-1])
            rows = [c[order] for c in rows]
            found = list(deal((mix(rows[0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), [rows[0].astype(np.uint64), *rows[1:]], parts)) if len(rows[0]) else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["home", "packed"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(v, columns) for batch in batches for v in batch.column("packed").to_pylist()]
        if found:
            rows = [np.concatenate([f[k].astype(np.int64) for f in found]) for k in range(columns)]
            found.clear()
            yield merge(rows)

    flags = dealt.repartitionById(parts, "block").mapInArrow(block, "home int, packed binary")
    return flags.repartitionById(parts, "home").mapInArrow(merged, schema)


def _repeated(h, key, tag, place) -> list[np.ndarray]:
    """Places of hashes that stand at different places."""
    order, first, differs = _grouped(h, key, tag, place)
    several = np.zeros(len(h), bool)
    several[first[differs]] = True
    own = order[several[first]]
    return [key[own], tag[own], place[own]]


def _later(h, key, tag, place) -> list[np.ndarray]:
    """Places that come after the first one of their hash, each with that one."""
    order, first, differs = _grouped(h, key, tag, place)
    own, source = order[differs], first[differs]
    return [key[own], tag[own], place[own], key[source], tag[source], place[source]]


def _deal_places(h, key, tag, place, parts: int, look) -> Iterator[tuple[int, bool, bytes]]:
    """What a lot sends to the blocks: the first place of each hash, and the places that the lot itself flags already."""
    if not len(h):
        return
    order, first, _ = _grouped(h, key, tag, place)
    once = np.sort(first[np.concatenate([[True], first[1:] != first[:-1]])])
    for b, value in deal((h[once] % np.uint64(parts)).astype(np.int64), [h[once], key[once], tag[once], place[once]], parts):
        yield b, False, value
    flagged = look(h, key, tag, place)
    if len(flagged[0]):
        order = np.lexsort(flagged[2::-1])
        flagged = [c[order] for c in flagged]
        for b, value in deal((mix(flagged[0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), [flagged[0].astype(np.uint64), *flagged[1:]], parts):
            yield b, True, value


def _rows(found: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    b, known, value = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known, pa.bool_()), pa.array(value, pa.binary())], names=["block", "known", "packed"])


DEALT = "block int, known boolean, packed binary"


def tag_column() -> Column:
    """What tells rows of one key apart, 63 bits: their text's crc, so that they are in its order, then 31 bits of another hash."""
    text = text_column()
    return F.shiftleft(F.crc32(text.cast("binary")), 31).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)))


def _texts(docs: DataFrame) -> DataFrame:
    """(key, tag, text): what all joins read, in one form, so that Spark moves the texts once and reads that exchange again."""
    return docs.select(key_column().alias("key"), tag_column().alias("tag"), text_column().alias("text"))


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, tag, start, size, source_key, source_tag, source_start, source_words): the parse of all documents, with each factor's words in its source.

    A place is a document's key (a null key: the smallest number), then a tag of its text (rows that share a
    key), then the word. Equal rows are one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lots(batches):
            lot = Lot(Words(rows.column("text")), window, anchor)
            at = lot.anchors()
            key, tag = (column_of(rows, c)[lot.doc[at]] for c in ("key", "tag"))
            yield _rows(list(_deal_places(lot.grams[at], key, tag, lot.place[at], parts, _repeated)))

    repeated = _lookup(texts.mapInArrow(anchors, DEALT), parts, 3, _repeated, _flagged_places, "key long, tag long, places binary")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lots(batches):
            lot = Lot(Words(rows.column("text")), window, anchor)
            flagged = np.zeros(len(lot.words), bool)
            for start, places in zip(lot.starts, rows.column("places").to_pylist()):
                flagged[start + unsqueezed(places)] = True
            at = lot.windows_with(flagged)
            key, tag = (column_of(rows, c)[lot.doc[at]] for c in ("key", "tag"))
            h = rolling(lot.words, window)[at] if len(at) else np.empty(0, np.uint64)
            yield _rows(list(_deal_places(h, key, tag, lot.place[at], parts, _later)))

    def parse(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in parsed(rows, window)], names=FACTOR)

    kinds = ", ".join(f"{c} long" for c in FACTOR)
    candidates = texts.join(repeated, ["key", "tag"]).select("key", "tag", "places", "text")
    found = _lookup(candidates.mapInArrow(windows, DEALT), parts, 6, _later, parse, kinds)

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            said = []
            for start, size, text in zip(batch.column("source_start").to_pylist(), batch.column("size").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text != last:
                    last, words = text, text.split()
                said.append(b" ".join(words[start : start + size]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FACTOR), pa.array(said, pa.binary())], names=[*FACTOR, "source_words"])

    once = texts.dropDuplicates(["key", "tag"]) if _has_repeats(docs) else texts
    asked = found.join(once.withColumnsRenamed({"key": "source_key", "tag": "source_tag"}), ["source_key", "source_tag"])
    return asked.select(*FACTOR, "text").mapInArrow(quote, f"{kinds}, source_words binary")


def equal_runs(words: list[bytes], source: bytes, least: int) -> list[tuple[int, int]]:
    """Runs of at least `least` words that a factor and its source share, place by place: all of it, unless different words had equal hashes."""
    if b" ".join(words) == source:
        return [(0, len(words))]
    differ = [k for k, (a, b) in enumerate(itertools.zip_longest(words, source.split())) if a != b]
    ends = [-1, *differ, len(words)]
    return [(a + 1, b) for a, b in zip(ends, ends[1:]) if b - a - 1 >= least]


def _has_repeats(docs: DataFrame) -> bool:
    """Whether rows share key and tag: only then have they to be told apart, at the price of a further exchange."""
    keyed = docs.select(key_column().alias("key"), tag_column().alias("tag"))
    return bool(keyed.groupBy("key", "tag").count().where("count > 1").head(1))


def remove_duplicates(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, factors, kept) of every row: factors are (start, end, source_id, source_start), the word spans removed and where their words stand first; kept are the words left, joined by one space.

    A null or empty text has no words; a text of fewer words than a window loses none; equal rows (key and
    text) are one document and lose the same words; rows that share a key only are ordered by their
    text's crc; a null key sorts first; an empty table gives no row; further columns are ignored.
    """
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, text in zip(batch.column("factors").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.split()
                spans = []
                for f in sorted(own or (), key=lambda f: (f["start"], f["size"])):
                    for a, b in equal_runs(words[f["start"] : f["start"] + f["size"]], f["source_words"], window):
                        spans.append({"start": f["start"] + a, "end": f["start"] + b, "source_id": None if f["source_key"] == NULL_KEY else f["source_key"], "source_start": f["source_start"] + a})
                kept, end = [], 0
                for f in spans:
                    kept += words[end : max(f["start"], end)]
                    end = max(end, f["end"])
                kept += words[end:]
                for column, value in zip(out, (len(words), len(words) - len(kept), spans, b" ".join(kept).decode())):
                    column.append(value)
            keys = pa.array([None if k == NULL_KEY else k for k in batch.column("key").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kinds), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "factors", "kept"])

    found = factors(docs, window)
    own = found.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "size", "source_key", "source_start", "source_words")).alias("factors"))
    joined = _texts(docs).join(own, ["key", "tag"], "left").select("key", "factors", "text")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, factors array<struct<start: int, end: int, source_id: long, source_start: long>>, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
