"""Operator 13, suffix-array dedup: bytes of passages that a document with a smaller id holds too, by sorting suffixes.

A passage is a window of 50 bytes. Suffixes that begin with the same window are neighbours in order, so a
sorted block of suffixes gives the windows that several documents hold, and the smallest id of each. Sorting
all suffixes of a corpus would move fifty bytes for each byte. So a sample comes first: a window's anchor is the
smallest hash of its runs of 20 bytes, equal windows have equal anchors, and only anchors at two places
or more (one byte in sixteen starts one) can belong to shared windows. The stretches of windows around
those go, as bytes, to blocks by their anchor, where their suffixes are sorted: by sixteen bytes, then by a
mergesort whose comparisons find the common extension of two suffixes by prefix hashes and binary search. The
order is verified on the bytes themselves; a collision of hashes has the block sorted with another base. How
suffixes compare beyond a window makes no difference and is left open.

A hot passage doesn't gather: a task sends its smallest id's stretches only, flagging the others
itself, and a block sorts what came so far before it takes more, keeping the smallest id's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_sort
from .common import small_batches, table
from .hashed_words import NULL_KEY, column_of, deal, key_column, lots, mix, pack, rolling, text_bytes, text_column, unpack
from .substring_dedup import DEALT, Lot, _deal_places, _flagged_places, _lookup, _repeated, _rows, unsqueezed

WINDOW, ANCHOR = 50, 20
#: Bytes of text that a task looks at together; longer texts are looked at in pieces.
LOT = 1 << 20
#: Different bytes, and stretches, that a task gathers before it sends them on.
GATHERED, STRETCHES = 24 << 20, 750_000
#: Places of anchors that a task gathers before it deals them out: rows exchanged are as many as lots times blocks.
PLACES = 1_000_000
#: Blocks a task sorts one after the other, and bytes that come in before a block is sorted. Places count as PLACE bytes.
BLOCKS, SORTED, PLACE = 8, 4 << 20, 24
#: Runs of flagged windows that a task gathers before it sends them on.
RUNS = 1_000_000
FLAGS = ("key", "tag", "start", "n")


class Symbols:
    """Bytes of some pieces of texts in a row, as Lot takes them."""

    def __init__(self, pieces: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(pieces)), self.sizes)
        self.bytes = np.concatenate(pieces) if pieces else np.empty(0, np.uint8)
        self.hashes = self.bytes.astype(np.uint64)


class ByteLot(Lot):
    """A Lot of bytes. Hashes of runs are mixed already; a run of zero bytes isn't the smallest, which stands for none."""

    def hashed(self, anchor: int) -> np.ndarray:
        return rolling(self.words, anchor) ^ np.uint64(0xA5A5)


def pieces(rows: pa.RecordBatch, window: int, limit: int = LOT) -> Iterator[tuple[Symbols, np.ndarray, np.ndarray]]:
    """(bytes, the row of each piece, its offset) for lots of twice `limit` bytes at most, and one piece. Pieces of a long text overlap by a window less one byte, so each window is in one piece."""
    data, bounds = text_bytes(rows.column("text"))
    held: list[tuple[int, int, int]] = []
    size = 0

    def lot():
        return Symbols([data[bounds[r] + a : bounds[r] + b] for r, a, b in held]), np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)

    for row, length in enumerate(np.diff(bounds).tolist()):
        for a in range(0, max(length - window + 1, 0), limit):
            b = min(length, a + limit + window - 1)
            held.append((row, a, b))
            size += b - a
            if size >= 2 * limit:
                yield lot()
                held, size = [], 0
    if held:
        yield lot()


def bundled(sizes: np.ndarray, data: bytes, entries: list[np.ndarray]) -> bytes:
    """Stretches of bytes and where they stand, (stretch, key, tag, place) each, as one value."""
    places = pack(*(c.astype(np.int64) if k else c.astype(np.uint64) for k, c in enumerate(entries)))
    head = np.array([len(sizes), len(places)], "<i8").tobytes() + sizes.astype("<i4").tobytes() + places
    return zstandard.ZstdCompressor(level=1).compress(head + data)


def unbundled(value: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, places = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + 4 * n
    entries = unpack(raw[at : at + places], 4)
    return np.frombuffer(raw, "<i4", n, 16).astype(np.int64), np.frombuffer(raw, np.uint8, -1, at + places), [entries[0].astype(np.int64), *entries[1:]]


class Stretches:
    """Runs of windows with one anchor that a task has met, the same bytes once."""

    def __init__(self, window: int, blocks: int):
        self.window, self.blocks = window, blocks
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: list[list[np.ndarray]] = []
        self.bytes = self.met = 0

    @property
    def full(self) -> bool:
        return self.bytes >= GATHERED or self.met >= STRETCHES

    def add(self, lot: Lot, data: np.ndarray, at: np.ndarray, key: np.ndarray, tag: np.ndarray, place: np.ndarray) -> None:
        """`at` are windows of a lot whose anchors are repeated; key, tag and place are theirs."""
        new = np.concatenate([[True], (np.diff(at) != 1) | (lot.doc[at[1:]] != lot.doc[at[:-1]]) | (lot.least[at[1:]] != lot.least[at[:-1]])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        begin, raw, ids, before = at[first], data.tobytes(), self.ids, len(self.ids)
        which = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(begin.tolist(), (begin + n + self.window - 1).tolist())], np.int64)
        fresh = np.unique(which[which >= before], return_index=True)[1]
        self.bytes += int((n[which >= before][fresh] + self.window - 1).sum())
        self.met += len(first)
        self.rows.append([which, key[first], tag[first], place[first], n, (lot.least[begin] % np.uint64(self.blocks)).astype(np.int64)])

    def sent(self) -> tuple[list[tuple[int, bytes]], list[np.ndarray]]:
        """((block, bundle) of each block, flags), and starts anew.

        Of equal stretches only the smallest key's go on; those of greater keys are flagged, as each of
        their windows stands in a smaller document here already.
        """
        if not self.rows:
            return [], [np.empty(0, np.int64)] * 4
        which, key, tag, place, n, block = (np.concatenate(c) for c in zip(*self.rows))
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, which, key)
        later = key > least[which]
        flags = [key[later], tag[later], place[later], n[later]]
        contents, out = list(self.ids), []
        order = np.flatnonzero(~later)
        order = order[np.lexsort((place[order], tag[order], key[order], block[order]))]
        edges = np.flatnonzero(np.diff(block[order])) + 1
        for own in np.split(order, edges):
            number = {k: i for i, k in enumerate(dict.fromkeys(which[own].tolist()))}  # in the order of places, which packs well
            stretch = np.array([number[k] for k in which[own].tolist()], np.int64)
            parts = [contents[k] for k in number]
            out.append((int(block[own[0]]), bundled(np.array([len(p) for p in parts]), b"".join(parts), [stretch, key[own], tag[own], place[own]])))
        self._clear()
        return out, flags


class Block:
    """Stretches that came so far, less those of which every window stands in a smaller document."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.entries = [[np.empty(0, np.int64)] * 4]
        self.alive = np.empty(0, bool)  # windows of the stretches that were here when it was last sorted
        self.known = self.held = self.bytes = 0

    def add(self, value: bytes) -> list[np.ndarray] | None:
        """Takes a bundle, and sorts once as much has come in as there is: so a suffix is sorted a number of times that grows with the logarithm of the block."""
        sizes, data, (stretch, *place) = unbundled(value)
        raw, ids, ends = data.tobytes(), self.ids, np.cumsum(sizes)
        before = len(ids)
        which = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
        self.bytes += int(sizes[which >= before].sum()) + PLACE * len(stretch)
        self.entries.append([which[stretch], *place])
        return self.sort() if self.bytes >= max(SORTED, self.held) else None

    def sort(self) -> list[np.ndarray]:
        """Flags of all windows that a smaller document is now known to hold."""
        window, contents = self.window, list(self.ids)
        sizes = np.array([len(c) for c in contents], np.int64)
        windows = sizes - window + 1
        first = np.cumsum(windows) - windows
        stretch, key, tag, place = (np.concatenate(c) for c in zip(*self.entries))
        came = np.zeros(len(sizes), bool)
        came[stretch[len(self.entries[0][0]) :]] = True
        least = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, stretch, key)
        later = key > least[stretch]
        flags = [[key[later], tag[later], place[later], windows[stretch[later]]]]
        # Equal rows of a table send the same places more than once.
        order = np.lexsort((place, tag, key))
        same = np.zeros(len(order), bool)
        same[1:] = (np.diff(key[order]) == 0) & (np.diff(tag[order]) == 0) & (np.diff(place[order]) == 0)
        kept = np.sort(order[~same & ~later[order]])
        stretch, key, tag, place = stretch[kept], key[kept], tag[kept], place[kept]
        of = np.repeat(np.arange(len(sizes)), windows)
        # Of a stretch that came again all windows are looked at again, for its new places.
        alive = came[of]
        alive[: len(self.alive)] |= self.alive
        data = np.frombuffer(b"".join(contents), np.uint8)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + np.arange(len(of)) - first[of]
        ordered, equal = suffix_sort.sort(data, at[alive], window)
        flat = np.empty(len(data), np.int64)  # the window that starts at a byte
        flat[at] = np.arange(len(at))
        ordered = flat[ordered]
        if len(ordered):
            k = least[of[ordered]]
            group = np.flatnonzero(~equal)
            dead = np.sort(ordered[k > np.repeat(np.minimum.reduceat(k, group), np.diff(np.append(group, len(k))))])
            alive[dead] = False
            flags.append(self._flags(dead, of, first, stretch, key, tag, place))
        keep = np.zeros(len(sizes), bool)
        keep[of[alive]] = True
        number, held = np.cumsum(keep) - 1, keep[stretch]
        self.ids = {c: i for i, c in enumerate(c for c, k in zip(contents, keep.tolist()) if k)}
        self.alive, self.entries = alive[keep[of]], [[number[stretch[held]], key[held], tag[held], place[held]]]
        self.held, self.bytes = int(sizes[keep].sum()) + PLACE * int(held.sum()), 0
        return [np.concatenate(c) for c in zip(*flags)]

    @staticmethod
    def _flags(dead, of, base, stretch, key, tag, place) -> list[np.ndarray]:
        """Runs of flagged windows, at each place where their stretch stands."""
        if not len(dead):
            return [np.empty(0, np.int64)] * 4
        s = of[dead]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(dead) != 1) | (np.diff(s) != 0)]))
        n, s, offset = np.diff(np.append(first, len(dead))), s[first], dead[first] - base[s[first]]
        order = np.argsort(stretch, kind="stable")
        low, high = np.searchsorted(stretch[order], s), np.searchsorted(stretch[order], s, side="right")
        times = high - low
        run = np.repeat(np.arange(len(s)), times)
        entry = order[low[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)]
        return [key[entry], tag[entry], place[entry] + offset[run], n[run]]


def coalesced(flags: list[np.ndarray]) -> list[np.ndarray]:
    """The same windows as fewer runs, in order: runs of a document that follow each other are one."""
    order = np.lexsort(flags[2::-1])
    key, tag, start, n = (c[order] for c in flags)
    new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(tag) != 0) | (start[1:] != (start + n)[:-1])])
    first = np.flatnonzero(new)
    return [key[first], tag[first], start[first], np.add.reduceat(n, first)]


def _sent(flags: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Flags packed by the task that puts a document's together."""
    if len(flags[0]):
        flags = coalesced(flags)
        yield from deal((mix(flags[0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), [flags[0].astype(np.uint64), *flags[1:]], parts)


def spans(flags: list[np.ndarray], window: int) -> pa.RecordBatch:
    """(key, tag, spans): maximal runs of covered bytes of each document, as start, end, start, end and so on."""
    order = np.lexsort(flags[2::-1])
    key, tag, start, n = (c[order] for c in flags)
    end = start + n - 1 + window
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["key", "tag", "spans"])
    doc = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(tag) != 0)])
    number = np.cumsum(doc) - 1
    # Running maximum of ends within a document: documents are set apart by more than any end.
    apart = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * apart) - number * apart
    new = doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    edges = np.stack([start[first], reach[np.append(first[1:] - 1, len(reach) - 1)]], axis=1).ravel()
    own = np.flatnonzero(doc[first])
    offsets = np.append(2 * own, 2 * len(first))
    return pa.RecordBatch.from_arrays([pa.array(key[first[own]]), pa.array(tag[first[own]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(edges))], names=["key", "tag", "spans"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(key_column().alias("key"), F.xxhash64(text_column()).alias("tag"), text_column().alias("text"))


def anchor_places(parts: int, window: int = WINDOW, anchor: int = ANCHOR):
    """What deals the places of texts' anchors out to `parts` blocks, for mapInArrow."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[list[np.ndarray]] = []

        def batch():
            places = [np.concatenate(c) for c in zip(*met)]
            met.clear()
            return _rows(list(_deal_places(*places, parts, _repeated)) if places else [])

        for rows in lots(batches, LOT):
            for symbols, row, offset in pieces(rows, window):
                lot = ByteLot(symbols, window, anchor)
                at = lot.anchors()
                doc = lot.doc[at]
                key, tag = (column_of(rows, c)[row[doc]] for c in ("key", "tag"))
                # 48 bits of a hash tell enough apart: equal ones of different bytes only make more stretches.
                met.append([lot.grams[at] >> np.uint64(16), key, tag, lot.place[at] + offset[doc]])
                if sum(len(m[0]) for m in met) >= PLACES:
                    yield batch()
        yield batch()

    return dealt


def shared_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, tag, spans) of the documents that hold windows of a document with a smaller key; the spans are those windows' bytes. A null key is the smallest number, the tag a hash of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs)

    repeated = _lookup(texts.mapInArrow(anchor_places(parts, window, anchor), DEALT), parts, 3, _repeated, _flagged_places, "key long, tag long, places binary")
    candidates = texts.join(repeated, ["key", "tag"]).select("key", "tag", "places", "text")
    blocks = parts * BLOCKS
    kind = pa.list_(pa.struct([("block", pa.int32()), ("bundle", pa.binary())]))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Stretches(window, blocks)

        def batch():
            own, flags = met.sent()
            bundles: dict[int, list[dict]] = {}
            for b, v in own:
                bundles.setdefault(b // BLOCKS, []).append({"block": b, "bundle": v})
            done = dict(_sent(flags, parts))
            to = sorted({*bundles, *done})
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([bundles.get(k, []) for k in to], kind), pa.array([done.get(k) for k in to], pa.binary())], names=["part", "bundles", "flags"])

        for rows in lots(batches, LOT):
            places, keys, tags = rows.column("places"), column_of(rows, "key"), column_of(rows, "tag")
            for symbols, row, offset in pieces(rows, window):
                lot = ByteLot(symbols, window, anchor)
                flagged = np.zeros(len(lot.words), bool)
                for start, size, r, o in zip(lot.starts, lot.sizes, row.tolist(), offset.tolist()):
                    own = unsqueezed(places[r].as_py()) - o
                    flagged[start + own[(own >= 0) & (own < size)]] = True
                at = lot.windows_with(flagged)
                if len(at):
                    doc = lot.doc[at]
                    met.add(lot, symbols.bytes, at, keys[row[doc]], tags[row[doc]], lot.place[at] + offset[doc])
                    if met.full:
                        yield batch()
        yield batch()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: list[list[np.ndarray]] = []
        bundles: dict[int, list[bytes]] = {}

        def batch():
            found = list(_sent([np.concatenate(c) for c in zip(*flags)], parts)) if flags else []
            flags.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["home", "packed"])

        def gathered() -> bool:
            return sum(len(f[0]) for f in flags) >= RUNS

        for rows in batches:
            for own, done in zip(rows.column("bundles").to_pylist(), rows.column("flags").to_pylist()):
                for b in own:
                    bundles.setdefault(b["block"], []).append(b["bundle"])
                if done is not None:
                    first, *others = unpack(done, 4)
                    flags.append([first.astype(np.int64), *others])
                    if gathered():
                        yield batch()
        while bundles:
            block = Block(window)
            for value in bundles.popitem()[1]:
                found = block.add(value)
                if found:
                    flags.append(found)
            if block.bytes:
                flags.append(block.sort())
            if gathered():
                yield batch()
        yield batch()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(v, 4) for batch in batches for v in batch.column("packed").to_pylist()]
        if found:
            yield spans([np.concatenate([f[k].astype(np.int64) for f in found]) for k in range(4)], window)

    dealt = candidates.mapInArrow(cut_out, "part int, bundles array<struct<block: int, bundle: binary>>, flags binary").repartitionById(parts, "part")
    flags = dealt.mapInArrow(judge, "home int, packed binary")
    return flags.repartitionById(parts, "home").mapInArrow(together, "key long, tag long, spans array<long>")


def remove_shared(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of every row: spans are start, end, start, end and so on, the maximal runs of bytes removed; kept are the other bytes, which needn't be UTF-8.

    A null text is empty; a text shorter than a window loses nothing. Rows that share a key don't
    take from each other, whatever their texts; a null key is the smallest. Repeated rows lose the same
    bytes. An empty table gives no row. Further columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, text in zip(batch.column("spans").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                edges = [0, *(own or ()), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(own or ()) // 2, kept)):
                    column.append(value)
            keys = pa.array([None if k == NULL_KEY else k for k in batch.column("key").to_pylist()], pa.int64())
            columns = [keys, *(pa.array(c, pa.int64()) for c in out[:3]), batch.column("spans"), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = _texts(docs).join(shared_spans(docs, window, anchor), ["key", "tag"], "left").select("key", "spans", "text")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
