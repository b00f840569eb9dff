"""Operator 1, benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

The unit is the word: lower-cased, ASCII punctuation taken as blanks. A passage of a document is a leak of
an item of L words if its edit distance to it is at most L / 5 words (a similarity of 0.8 or more); an
item of fewer than five words must be met exactly.

A window within k edits of an item shares all but 2k of its different word pairs with it. Only stretches of a
document with that many of an item's pairs are looked at further; this loses no case. A CGK embedding walks
along a window: at each step it writes the word it stands on and moves on if a random bit of step and word
says so, so that two sequences that differ by an edit fall into step again and few coordinates differ: edit
distance becomes Hamming distance. Bit sampling compares a few random coordinates of a window's and an
item's embedding, again and again.

How many samples the target recall takes is measured for each length at its own edit limit, for the kind of
edit that drives embeddings furthest apart (repetitions). The share of equal coordinates falls with the
length, so an item of many words is looked up by pieces of about PIECE words: of a passage within L / 5 edits
one piece at least has no more than its share of them. Windows that agree with a piece once give the
stretch that is verified by the exact edit distance of the whole item, in bit vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .hashed_words import Words, lots, rolling, text_column

#: Edits allowed, as a share of the item's words.
EDIT_SHARE = 0.2
#: Items of fewer words allow no edit: they are looked up as they are.
LEAST_WORDS = 5
#: Target recall of a passage at that distance, coordinates of a sample, random walks, words of a piece.
RECALL, BITS, WALKS, PIECE = 0.99, 2, 6, 24
#: Items are searched in blocks of at most so many bytes, each block given to all tasks.
BLOCK_BYTES = 16_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCTUATION, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(PUNCTUATION))
PLAIN_TABLE = np.frombuffer(PLAIN, np.uint8)

Leak = tuple[int, int, int, int]  # item, first word, words, distance


def edit_limit(words: int) -> int:
    return int(EDIT_SHARE * words + 1e-9)


def cgk(x: np.ndarray, starts: np.ndarray, length: int, walks: int = WALKS) -> np.ndarray:
    """Embeddings (walk, window, step) of the windows of x from starts: twice `length` steps each, 0 beyond the window's end."""
    at = np.tile(starts, (walks, 1))
    end = np.minimum(starts + length, len(x))
    salts = (np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(1_000_003))[:, None]
    out = np.zeros((walks, len(starts), 2 * length), np.uint64)
    last = len(x) - 1
    for j in range(2 * length):
        word = np.where(at < end, x[np.minimum(at, last)], np.uint64(0))
        out[:, :, j] = word
        salt = (salts + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        at += (word * salt >> np.uint64(63)).astype(np.int64)  # words are hashes: the top bit of a product is as good as random
    return out


@lru_cache(maxsize=None)
def repetitions(length: int, recall: float = RECALL, bits: int = BITS, walks: int = WALKS) -> int:
    """Samples of each walk with which a passage of that length, as many edits away as allowed, is met with the target recall.

    Measured on random passages between other words, in all windows that start as many words around as edits are
    allowed; deletions, insertions and replacements by themselves: the kind that needs most decides.
    """
    k, trials = edit_limit(length), 300
    rng = np.random.default_rng(length)
    word = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    most = 1
    for kind in ("delete", "insert", "replace"):
        items, others = [], []
        for _ in range(trials):
            item = word(length)
            at = rng.choice(length, k, replace=False)
            other = np.delete(item, at) if kind == "delete" else np.insert(item, at, word(k)) if kind == "insert" else item.copy()
            if kind == "replace":
                other[at] = word(k)
            items.append(item)
            others.append(np.concatenate([word(length), other, word(length)]))
        begin = np.cumsum([0, *map(len, others[:-1])])
        one = cgk(np.concatenate(items), np.arange(trials) * length, length, walks)[:, :, None]
        two = cgk(np.concatenate(others), (begin[:, None] + np.arange(length - k, length + k + 1)).ravel(), length, walks).reshape(walks, trials, 2 * k + 1, -1)
        met = np.maximum(((one == two) & (one != 0)).mean(3) ** bits, 1e-9)
        while most < 5000 and np.mean(np.prod((1 - met) ** most, (0, 2))) > 1 - recall:
            most += 1 + most // 8
    return 4 * most  # all windows are sampled at the same coordinates, so their chances aren't independent


class Bits:
    """Myers' bit vectors of an item: the edit distance of the item to stretches of a text, one step a word."""

    def __init__(self, item: np.ndarray):
        self.at: dict[int, int] = {}
        for i, w in enumerate(item.tolist()):
            self.at[w] = self.at.get(w, 0) | 1 << i
        self.size = len(item)

    def distances(self, x: list[int], anchored: bool = False) -> list[int]:
        """For each end, the least distance of the item to a stretch of x that ends there; anchored: to all of x up to there."""
        mask, top = (1 << self.size) - 1, 1 << self.size - 1
        more, less, here, out = mask, 0, self.size, []
        for v in x:
            equal = self.at.get(v, 0)
            down = equal | less
            across = ((equal & more) + more & mask ^ more) | equal
            up, lower = less | mask & ~(across | more), more & across
            if up & top:
                here += 1
            elif lower & top:
                here -= 1
            out.append(here)
            up, lower = up << 1 & mask | anchored, lower << 1 & mask
            more, less = lower | mask & ~(down | up), up & down
        return out


def passages(item: np.ndarray, x: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of stretches of x within `limit` edits of the item: the nearest first, each the shortest of its end, none overlapping another. At least one if there is any."""
    words = x.tolist()
    far = np.array(Bits(item).distances(words), np.int64)
    ends = np.flatnonzero(far <= limit)
    backwards = Bits(item[::-1])
    taken = np.zeros(len(words) + 1, bool)
    least = len(item) - limit
    out = []
    for e in ends[np.argsort(far[ends], kind="stable")].tolist():
        # A passage has `least` words at least: one that would begin in a passage taken is out.
        if taken[max(0, e - least + 1) : e + 1].any():
            continue
        lo = max(0, e + 1 - len(item) - limit)
        back = backwards.distances(words[lo : e + 1][::-1], anchored=True)
        s = e - back.index(far[e]) if far[e] in back else None
        if s is not None and not taken[s : e + 1].any():
            taken[s : e + 1] = True
            out.append((s, e + 1, int(far[e])))
    return out


class Searcher:
    """Looks for the items of a block in texts."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words = Words(pa.array([t for _, t in items], pa.binary()), PLAIN_TABLE)
        found = [(i, words.hashes[s : s + n]) for (i, _), s, n in zip(items, words.starts.tolist(), words.sizes.tolist()) if n]
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in range(1, LEAST_WORDS):
            by_hash: dict[int, list[int]] = {}
            for i, w in found:
                if len(w) == n:
                    by_hash.setdefault(int(rolling(w, n)[0]), []).append(i)
            if by_hash:
                known = np.array(sorted(by_hash), np.uint64)
                self.short[n] = known, [by_hash[h] for h in known.tolist()]
        self.items = [(i, w) for i, w in found if len(w) >= LEAST_WORDS]
        if not self.items:
            return
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.edits = np.array([edit_limit(n) for n in self.lengths], np.int64)
        pairs = [np.unique(rolling(w, 2)) for _, w in self.items]
        # Each edit touches two word pairs at most, so a passage near an item has all but 2k of its different pairs.
        self.distinct = np.maximum(np.array([len(p) for p in pairs]) - 2 * self.edits, 1)
        flat, owner = np.concatenate(pairs), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(flat, kind="stable")
        self.pairs, first = np.unique(flat[order], return_index=True)
        self.owners, self.owner_at = owner[order], np.append(first, len(flat))
        self.slots = np.zeros(1 << 22, bool)
        self.slots[(self.pairs & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        # Any passage that qualifies holds `dense` pairs within `narrow` words: it is covered by so many narrow windows that one has its share.
        self.narrow = int((self.lengths + self.edits).min())
        self.dense = int(np.ceil(self.distinct / np.ceil((self.lengths + self.edits) / self.narrow)).min())
        self.wide = int((self.lengths + self.edits).max())
        self.samples: dict[int, np.ndarray] = {}
        self.embedded: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def _pieces(self, k: int) -> list[tuple[int, int, np.ndarray]]:
        """(place, words, sampled coordinates of each walk) of the item's pieces, kept for the items that are met."""
        if k not in self.embedded:
            w = self.items[k][1]
            cuts = np.linspace(0, len(w), max(1, round(len(w) / PIECE)) + 1).astype(int).tolist()
            self.embedded[k] = [(a, b - a, self._sampled(w, np.array([a]), b - a)[:, 0]) for a, b in zip(cuts, cuts[1:])]
        return self.embedded[k]

    def _sampled(self, x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """(walk, window, sample, bit) of the windows' embeddings."""
        if length not in self.samples:
            self.samples[length] = np.random.default_rng(11).integers(0, 2 * length, (WALKS, repetitions(length), BITS))
        whole = cgk(x, starts, length)
        return np.stack([own[:, at] for own, at in zip(whole, self.samples[length])])

    def _met(self, k: int, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Starts of passages that the item's pieces point to, for passages that start from lo to hi: windows that agree with a piece in a sample. A sample beyond both ends says nothing."""
        met, limit = [], int(self.edits[k])
        for place, length, sampled in self._pieces(k):
            starts = np.arange(max(0, lo + place - limit), min(hi + place + limit + 1, len(x)))
            for part in np.array_split(starts, len(starts) // 2000 + 1):
                own = self._sampled(x, part, length)
                same = ((own == sampled[:, None]) & (own != 0)).all(3).any(2).any(0)
                met.append(part[same] - place)
        return np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)

    def search(self, texts: pa.Array) -> list[list[Leak]]:
        """The leaks of each text, by item and place."""
        out: list[list[Leak]] = [[] for _ in range(len(texts))]
        words = Words(texts, PLAIN_TABLE)
        x = words.hashes
        ends = words.starts + words.sizes
        for n, (known, owners) in self.short.items():
            h = rolling(x, n) if len(x) >= n else x[:0]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            free: dict[tuple[int, int], int] = {}
            for p in np.flatnonzero(known[at] == h).tolist():
                d = int(words.doc[p])
                if p + n <= ends[d] and free.get((d, at[p]), 0) <= p:
                    free[d, at[p]] = p + n
                    out[d] += [(i, p - int(words.starts[d]), n, 0) for i in owners[at[p]]]
        if self.items and len(x) >= 2:
            self._long(x, ends, words.sizes, out)
        return [sorted(set(found)) for found in out]

    def _long(self, x: np.ndarray, ends: np.ndarray, sizes: np.ndarray, out: list[list[Leak]]) -> None:
        pairs = rolling(x, 2)
        maybe = np.flatnonzero(self.slots[(pairs & np.uint64((1 << 22) - 1)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.pairs, pairs[maybe]), len(self.pairs) - 1)
        known = self.pairs[index] == pairs[maybe]
        maybe, index = maybe[known], index[known]
        before = np.concatenate([[0], np.cumsum(np.bincount(maybe, minlength=len(x)))])
        start = np.arange(len(x))
        dense = np.flatnonzero(before[np.minimum(start + self.narrow, len(x))] - before[start] >= self.dense)
        if not len(dense):
            return
        doc = np.searchsorted(ends, dense, side="right")
        breaks = np.flatnonzero((np.diff(dense) > 2 * self.wide) | (np.diff(doc) > 0))
        for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(dense) - 1)):
            d = int(doc[a])
            # A dense window can begin in the document before: the stretch then reaches into the next one as well.
            for own in range(d, int(np.searchsorted(ends, min(dense[b] + self.narrow, len(x)) - 1, side="right")) + 1):
                lo = max(int(dense[a]) - self.wide, int(ends[own] - sizes[own]))
                hi = min(int(dense[b]) + self.narrow + self.wide, int(ends[own]))
                if hi - lo >= 2:
                    out[own] += self._stretch(x, lo, hi, int(ends[own] - sizes[own]), maybe, index)

    def _stretch(self, x, lo: int, hi: int, first: int, maybe, index) -> Iterator[Leak]:
        inside = slice(np.searchsorted(maybe, lo), np.searchsorted(maybe, hi - 1))
        hits, at = index[inside], maybe[inside]
        if len(hits) < self.distinct.min():
            return
        kinds = np.unique(hits)
        held = np.bincount(np.concatenate([self.owners[self.owner_at[h] : self.owner_at[h + 1]] for h in kinds]), minlength=len(self.items))
        if not (held >= self.distinct).any():
            return
        shared = [self.owners[self.owner_at[h] : self.owner_at[h + 1]] for h in hits]
        sizes = [len(o) for o in shared]
        owners, places, pair = np.concatenate(shared), np.repeat(at - lo, sizes), np.repeat(hits, sizes)
        own = x[lo:hi]
        for k in np.flatnonzero(held >= self.distinct).tolist():
            # A passage near the item has the pairs needed within the longest such passage from its start.
            limit = int(self.edits[k])
            reach = int(self.lengths[k]) + limit
            mine = owners == k
            place, kind = places[mine], pair[mine]
            before = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(own)))])
            start = np.arange(len(own))
            starts = np.flatnonzero(before[np.minimum(start + reach - 1, len(own))] - before[start] >= self.distinct[k])
            # Common pairs said again and again aren't a passage: each lot of adjacent starts needs enough different ones.
            groups = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1) if len(starts) else []
            met = [self._met(k, own, int(g[0]), int(g[-1])) for g in groups if len(np.unique(kind[(place >= g[0]) & (place < g[-1] + reach)])) >= self.distinct[k]]
            met = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
            done = 0
            for g in np.split(met, np.flatnonzero(np.diff(met) > 2 * reach) + 1) if len(met) else []:
                # Edits before a piece shift the passage's start by their number.
                a, b = max(done, int(g[0]) - limit), min(len(own), int(g[-1]) + reach + limit)
                if b - a >= self.lengths[k] - limit:
                    yield from ((self.items[k][0], lo - first + a + s, e - s, d) for s, e, d in passages(self.items[k][1], own[a:b], limit))
                done = max(done, b)


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """The items in blocks of about BLOCK_BYTES, dealt by a hash, one at a time; null texts and keys are left out, equal rows count once."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    n = math.ceil((rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0) / BLOCK_BYTES)
    return n, (sorted((r.item_id, bytes(r.text)) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()) for k in range(n))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance), a row for each passage of a document that is near an item.

    A document without leaks, or with a null or empty text, has no row; repeated rows of documents are
    searched each; passages of one item don't overlap; an item without words is nowhere; an empty table
    gives no row; further columns are ignored. Maps only: a pass over the documents for each block of
    items, which is one for any benchmark of up to 16 MB. Where there are more blocks, each one's leaks
    are written before the next block is fetched.
    """
    small_batches(docs.sparkSession)
    kinds = "doc_id long, item_id long, start_word long, n_words long, distance long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))

    def searched(items: list[tuple[int, bytes]]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items)
            for lot in lots(batches):
                found = [(d, *leak) for d, leaks in zip(lot.column("doc_id").to_pylist(), searcher.search(lot.column("text"))) for leak in leaks]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)], names=["doc_id", "item_id", "start_word", "n_words", "distance"])

        return rows.mapInArrow(search, kinds)

    n, blocks = _blocks(benchmark)
    out = None
    for items in blocks:
        found = searched(items) if n == 1 else written(searched(items), "leaks")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leak, with all their columns; a null or empty text has none, repeated rows are judged each."""
    small_batches(docs.sparkSession)

    def clean(items: list[tuple[int, bytes]]):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items)
            for batch in batches:
                yield batch.filter(pa.array([not x for x in searcher.search(batch.column("text"))], pa.bool_()))

        return keep

    n, blocks = _blocks(benchmark)
    for items in blocks:
        left = docs.mapInArrow(clean(items), docs.schema)
        docs = left if n == 1 else written(left, "clean")
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
