"""Operator 9, n-gram Jaccard join: adaptive multi-match prefixes.

All documents' shingles are put in one order, rare ones first. If two sets of sizes n and m share at
least a = ceil(t * max(n, m)) elements, then for any l the first n - ceil(t * n) + l of one and the first
m - ceil(t * m) + l of the other share at least l. Each document picks its own l by cost: a longer prefix
lists it under more shingles, but a partner must share more of them before the sets are compared. Two
documents are compared when they share as many listed shingles as the smaller of their l. As the sizes of
a pair are known by then, only entries among its first n - o + l count, with o = t / (1 + t) * (n + m).

Only connections matter, so partners that are connected already aren't compared again: in a first step
each document of a list is compared with one other of it, and in a second step only documents of
different components are, all those that the lists and l call for. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, fresh, small_batches, table, written
from .components import components
from .hashed_words import LOWER, Words, column_of, deal, lots, mix, rolling, text_column, unpack

SHINGLE, PERCENT = 3, 90
#: Longest extension of a prefix; cost of listing a shingle and of comparing two sets, in list entries read.
MOST_MATCHES, LIST_COST, COMPARE_COST = 4, 4.0, 20.0
#: Slots of the frequency sketch: a fixed size, whatever the corpus' is. It only orders shingles.
SLOTS, SLICES = 1 << 20, 64
#: A null key sorts last, so it is never the id of a component that has another.
NULL_KEY = 2**63 - 1


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words than a shingle, one hash of all."""
    words = Words(texts, LOWER)
    flat = words.hashes
    grams = rolling(flat, size) if len(flat) >= size else np.empty(0, np.uint64)
    out = []
    for at, n in zip(words.starts.tolist(), words.sizes.tolist()):
        if n >= size:
            own = np.sort(grams[at : at + n - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            out.append(mix(rolling(flat[at : at + n], n) ^ np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def needed_overlap(n, m, percent: int):
    """What two sets must share: t / (1 + t) of both sizes, rounded up."""
    return -(-percent * (n + m) // (100 + percent))


def reaches(place, n, m, matches, percent: int):
    """Whether an entry can be one of the first `matches` shared ones of a set of size n with a similar set of size m: places from 1 in the common order."""
    return place <= n - needed_overlap(n, m, percent) + matches


def prefix(ordered_cost: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(length, l) of the prefix whose estimated cost is least. ordered_cost: expected partners of each shingle, in the common order."""
    base = n - least_overlap(n, percent)
    best = None
    for matches in range(1, MOST_MATCHES + 1):
        length = base + matches
        if length > n:
            break
        partners = float(ordered_cost[:length].sum())
        cost = LIST_COST * length + partners + COMPARE_COST * partners / matches**2
        if best is None or cost < best[0]:
            best = (cost, length, matches)
    return best[1], best[2]


def _sketch(texts: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """The written table (doc_id, key, tag, n_shingles, signature) of all rows, and how many sets hold a shingle of each slot."""
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        rows: list[list] = [[], [], [], [], []]
        names = ["doc_id", "key", "tag", "n_shingles", "signature", "slice", "counts"]

        def out(slice_: list, counts: list) -> pa.RecordBatch:
            k, n = len(rows[0]), len(slice_)
            own = [pa.array(c + [None] * n, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*own, pa.array([None] * k + slice_, pa.int32()), pa.array([None] * k + counts, pa.binary())], names=names)

        for lot in lots(batches):
            found = shingle_sets(lot.column("text"), size)
            slots += np.bincount((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            for column, values in zip(rows, (*(lot.column(c).to_pylist() for c in names[:3]), map(len, found), (xxhash.xxh3_128_digest(s.tobytes()) for s in found))):
                column.extend(values)
            if len(rows[0]) > 5000:
                yield out([], [])
                rows = [[], [], [], [], []]
        yield out(list(range(SLICES)), [x.astype("<u4").tobytes() for x in slots.reshape(SLICES, -1)])

    both = written(texts.select("doc_id", "key", "tag", "text").mapInArrow(sets, "doc_id long, key long, tag long, n_shingles long, signature binary, slice int, counts binary"), "sets")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    slots = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in both.where("slice is not null").select("slice", "counts").repartitionById(SLICES, "slice").mapInArrow(added, "slice int, counts binary").collect():
        slots[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return both.where("slice is null").drop("slice", "counts"), slots.reshape(-1).astype(np.float32)


def _lists(texts: DataFrame, slots: np.ndarray, size: int, percent: int) -> DataFrame:
    """Written table of the lists with two texts or more: (token, key, tag, n, matches), and (key, tag, key2, tag2) of the pairs compared first.

    A list holds each text once, under its first key: copies are connected by their equal sets.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(slots)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        usual = float(np.median(counts))
        for lot in lots(batches):
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            # Of copies in the lot, the first key is enough.
            order = np.lexsort((column_of(lot, "key"), column_of(lot, "tag")))
            tags = column_of(lot, "tag")[order]
            lot = lot.take(pa.array(order[np.concatenate([[True], tags[1:] != tags[:-1]])]))
            for key, tag, s in zip(lot.column("key").to_pylist(), lot.column("tag").to_pylist(), shingle_sets(lot.column("text"), size)):
                if not len(s):
                    continue
                seen = counts[(s % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((s, seen))
                length, matches = prefix(np.maximum(seen[order[: len(s) - least_overlap(len(s), percent) + MOST_MATCHES]] - usual, 0), len(s), percent)
                own = s[order[:length]]
                for column, value in zip(columns, (own, *(np.full(length, v, np.int64) for v in (key, tag, len(s), matches)), np.arange(1, length + 1))):
                    column.append(value)
            if columns[0]:
                flat = [np.concatenate(c) for c in columns]
                b, value = zip(*deal((flat[0] % np.uint64(parts)).astype(np.int64), flat, parts))
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(value, pa.binary())], names=["block", "packed"])

    names = ["token", "key", "tag", "n", "matches", "place", "key2", "tag2"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = [unpack(v, 6) for batch in batches for v in batch.column(1).to_pylist()]
        if not lots:
            return
        columns = [np.concatenate(c) for c in zip(*lots)]
        lots.clear()
        token, key, tag = columns[:3]
        order = np.lexsort((key, tag, token))
        order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (tag[order][1:] != tag[order][:-1])])]
        columns = [c[order] for c in columns]
        # The text that has the shingle first in its order has the fewest rarer ones: the middle of a group of near copies.
        order = np.lexsort((columns[1], columns[5], columns[0]))
        token, key, tag, n, matches, place = (c[order] for c in columns)
        new = np.concatenate([[True], token[1:] != token[:-1]])
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        # The smallest set of its list that a set could be similar to decides whether its entry can matter.
        least = np.maximum(np.minimum.reduceat(n, first)[of], least_overlap(n, percent))
        many = (np.diff(np.append(first, len(token)))[of] > 1) & reaches(place, n, least, matches, percent)
        # Compared first: every text of a list with the one in its middle.
        at = np.flatnonzero(many & ~new)
        other = first[of[at]]
        both = np.minimum(matches[at], matches[other])
        fits = (100 * np.minimum(n[at], n[other]) >= percent * np.maximum(n[at], n[other])) & reaches(place[at], n[at], n[other], both, percent) & reaches(place[other], n[other], n[at], both, percent)
        at, other = at[fits], other[fits]
        pairs = np.unique(np.stack([key[other], tag[other], key[at], tag[at]], 1), axis=0) if len(at) else np.empty((0, 4), np.int64)
        kept = np.flatnonzero(many)
        for lo in range(0, len(kept), 50_000):
            k = kept[lo : lo + 50_000]
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(token[k].view(np.int64)), *(pa.array(c[k]) for c in (key, tag, n, matches, place)), none, none], names=names)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none, pa.array(pairs[:, 2]), pa.array(pairs[:, 3])], names=names)

    dealt = texts.select("key", "tag", "text").mapInArrow(listed, "block int, packed binary")
    return written(dealt.repartitionById(parts, "block").mapInArrow(joined, ", ".join(f"{c} long" for c in names)), "lists")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (key, tag, key2, tag2), the links (u, v): exact comparison of the two sets."""
    one = texts.select("key", "tag", F.col("text").alias("text1"))
    two = texts.select(F.col("key").alias("key2"), F.col("tag").alias("tag2"), F.col("text").alias("text2"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (x for one in lots(batches, text="text1") for x in lots([one], text="text2")):
            keep = []
            for x, y in zip(*(shingle_sets(lot.column(c), size) for c in ("text1", "text2"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield lot.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(one, ["key", "tag"]).join(two, ["key2", "tag2"]).select(F.col("key").alias("u"), F.col("key2").alias("v"), "text1", "text2")
    return rows.mapInArrow(compared, "u long, v long")


def link_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id) of every row; tag is a hash of its text.

    A null, empty or blank text has no shingles and no link; with fewer words than a shingle all of them
    are its one shingle. Rows that share a key are one node of the links, whatever their texts. Rows
    without a key are linked through their texts as one node, which never names a component that has a
    key; alone, their component is null. An empty table gives no row; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = text_column()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    sets, slots = _sketch(texts, size)
    # Equal sets are one class: every key of it is linked with its first.
    some = sets.where("n_shingles > 0")
    classes = written(some.groupBy("signature").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last"), "classes")
    same = some.join(classes, "signature").select(F.col("key").alias("u"), F.col("first").alias("v")).where("u != v").distinct()
    lists = _lists(texts, slots, size, percent)
    first = written(lists.where("token is null").select("key", "tag", "key2", "tag2").distinct(), "pairs")
    repeated = some.groupBy("key", "tag").count().where("count > 1").head(1)
    bodies = texts.select("key", "tag", "text")
    bodies = bodies.dropDuplicates(["key", "tag"]) if repeated else bodies
    links = written(same.unionByName(_linked(first, bodies, size, percent)), "links")
    found = written(components(links), "components")
    # Second step: lists that hold different components.
    named = lists.where("token is not null").join(found.withColumnRenamed("node", "key"), "key", "left").select("token", "key", "tag", "n", "matches", "place", F.coalesce("component", "key").alias("component"))
    named = written(named, "named")
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    left = written(named.join(written(mixed, "mixed"), "token", "left_semi"), "left")
    # What a text shares first stands no earlier than its first entry; a text whose first entry stands too late for a pair is not paired.
    left = left.withColumn("first", F.min("place").over(Window.partitionBy("key", "tag")))
    a, b = left.alias("a"), left.alias("b")
    sized = (100 * F.col("a.n") >= percent * F.col("b.n")) & (100 * F.col("b.n") >= percent * F.col("a.n"))
    needed = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / F.lit(float(100 + percent)) - 1e-9)
    spare = F.least("a.matches", "b.matches") - needed
    near = (F.col("a.place") <= F.col("a.n") + spare) & (F.col("b.place") <= F.col("b.n") + spare)
    early = (F.col("a.first") <= F.col("a.n") - needed + 1) & (F.col("b.first") <= F.col("b.n") - needed + 1)
    shared = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & sized & early & near)
    pairs = (
        shared.groupBy(F.col("a.key").alias("key"), F.col("a.tag").alias("tag"), F.col("b.key").alias("key2"), F.col("b.tag").alias("tag2"))
        .agg(F.count("*").alias("shared"), F.min(F.least("a.matches", "b.matches")).alias("needed"))
        .where("shared >= needed")
        .select("key", "tag", "key2", "tag2")
    )
    more = written(pairs.join(first, ["key", "tag", "key2", "tag2"], "left_anti"), "pairs")
    rest = written(_linked(more, bodies, size, percent), "links")
    final = components(links.unionByName(rest)) if rest.head(1) else found
    named_rows = sets.join(final.withColumnRenamed("node", "key"), "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))
    return named_rows.select("doc_id", "tag", "n_shingles", F.nullif(component, F.lit(NULL_KEY)).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of linked documents stays: the smallest key, of its rows the smallest hash of a text. Texts without words all stay."""
    key, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)), F.xxhash64(text_column())
    own = fresh(docs.columns, "key", "tag")
    rows = written(link_classes(docs, size, percent).where("n_shingles > 0").select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias(own[0]), F.col("tag").alias(own[1]), F.coalesce("component_id", F.lit(NULL_KEY)).alias("component")), "groups")
    kept = rows.groupBy("component").agg(F.min(F.struct(*own)).alias("first")).select("first.*")
    gone = written(rows.join(kept, own, "left_anti").select(*own).distinct(), "gone")
    named = docs.withColumns(dict(zip(own, (key, tag))))
    left = named.join(gone, own, "left_anti")
    again = written(rows.groupBy(*own).agg(F.count("*").alias("times")).where("times > 1").select(*own), "again")
    if again.head(1):  # equal rows: all but one of each go
        left = left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates(own))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
