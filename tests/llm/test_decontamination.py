import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination as D

from .cases import documents, rows

ITEMS = "item_id long, text string, key string"


def plain(text):
    return (text or "").encode().translate(D.PLAIN).split()


def nearest(item, x):
    """Least edit distance of the item to any stretch of x."""
    row = [0] * (len(x) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, v in enumerate(x, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (w != v)))
        row = now
    return min(row)


def whole(a, b):
    """Edit distance of two lists."""
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        now = [i]
        for j, v in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (w != v)))
        row = now
    return row[-1]


def arrow(texts):
    return pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=16))
def test_passages(item, x):
    found = D.passages(np.array(item, np.uint64), np.array(x, np.uint64), len(item) // 2)
    assert bool(found) == (nearest(item, x) <= len(item) // 2 and min((nearest(item, x[:e][s:]) for e in range(1, len(x) + 1) for s in range(e)), default=99) <= len(item) // 2)
    taken = set()
    for s, e, d in found:
        assert 0 <= s < e <= len(x) and whole(item, x[s:e]) == d <= len(item) // 2 and not taken & set(range(s, e))
        taken |= set(range(s, e))
    assert not found or min(d for *_, d in found) == nearest(item, x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(0, 3), max_size=90))
def test_bit_vectors(item, x):
    bits = D.Bits(np.array(item, np.uint64))
    assert min([len(item), *bits.distances(x)]) == nearest(item, x)
    assert bits.distances(x, anchored=True) == [whole(item, x[:k]) for k in range(1, len(x) + 1)]


def test_recall_of_long_items_at_the_limit_by_kind_of_edit():
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    met = Counter()
    for n in (20, 80, 150, 300):
        item = [word() for _ in range(n)]
        searcher = D.Searcher([(1, " ".join(item).encode())])
        for kind in ("delete", "insert", "replace", "mixed"):
            texts = []
            for _ in range(25):
                w = list(item)
                for p in sorted(rng.sample(range(n), n // 5), reverse=True):
                    w[p : p + 1] = {"delete": [], "insert": [w[p], word()], "replace": [word()]}[rng.choice(["delete", "insert", "replace"]) if kind == "mixed" else kind]
                texts.append(" ".join([word() for _ in range(40)] + w + [word() for _ in range(40)]).encode())
            met[kind] += sum(map(bool, searcher.search(arrow(texts))))
    assert all(m >= 0.97 * 4 * 25 for m in met.values()), met


def test_an_item_said_thousands_of_times():
    rng = random.Random(2)
    item = [f"v{rng.randrange(3000)}" for _ in range(8)]
    searcher = D.Searcher([(1, " ".join(item).encode()), (2, b"far away")])
    for text, distance in ((item, 0), (item[:7] + ["zz"], 1)):
        began = time.perf_counter()
        found = searcher.search(arrow([" ".join(text * 5000), " ".join(text * 3)]))
        assert time.perf_counter() - began < 10  # linear: a loop over pairs of places takes minutes
        assert [len(f) for f in found] == [5000, 3] and all(f[3] == distance for own in found for f in own)


def test_short_items_are_met_exactly():
    searcher = D.Searcher([(1, b"Blue whale"), (2, b"whale"), (3, b"..."), (4, b"one two three four")])
    found = searcher.search(arrow(["a blue, whale!", "blue", "whale blue whale blue whale", "one two three", "x one two three four", None, "blue"]))
    assert found == [[(1, 1, 2, 0), (2, 2, 1, 0)], [], [(1, 1, 2, 0), (1, 3, 2, 0), (2, 0, 1, 0), (2, 2, 1, 0), (2, 4, 1, 0)], [], [(4, 1, 4, 0)], [], []]


def test_embedding_keeps_near_sequences_near():
    rng = np.random.default_rng(4)
    near, far = [], []
    for _ in range(100):
        x = rng.integers(1, 2**60, 40).astype(np.uint64)
        y = np.delete(x, rng.integers(0, 40, 2))
        z = rng.integers(1, 2**60, 40).astype(np.uint64)
        one, two, three = (D.cgk(v, np.zeros(1, np.int64), 40, 1)[0, 0] for v in (x, y, z))
        near.append((one == two).mean()), far.append((one == three).mean())
    assert np.mean(near) > 0.5 > 0.3 > np.mean(far)


def planted(seed=9):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 15, 18, 30, 55])))) for k in range(30)]
    items += [(100, "of the and"), (101, ""), (102, None), (None, "no key at all but many words here in it"), (103, "Caps, AND stops: one (two) three four five six!")]
    docs = []
    for k in range(120):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if k % 2:
            _, text = items[rng.randrange(30)]
            w = text.split()
            for _ in range(rng.randrange(0, max(1, int(len(w) * 0.2)) + 2)):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[], [word()], [w[p], word()]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((k, " ".join(body), "en", "s", 1, *["z"] * 10))
    docs.append((500, "x y caps and stops one two three four five six z", "en", "s", 1, *["z"] * 10))
    docs.append((501, items[3][1] + " gap " * 70 + items[3][1], "en", "s", 1, *["z"] * 10))
    return [(*i, "z") for i in items], docs


def test_leaks_against_brute_force(spark):
    items, docs = planted()
    docs = docs + [(2000 + k, *r[1:]) for k, r in enumerate(rows())]
    found = D.find_leaks(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want, exact = set(), set()
    for item, text, _ in items:
        w = plain(text)
        if item is not None and w:
            for doc, body, *_ in docs:
                d = nearest(w, plain(body))
                if d < len(w) and d <= int(0.2 * len(w) + 1e-9):
                    want.add((doc, item))
                    if d == 0:
                        exact.add((doc, item))
    assert got <= want and exact <= got and len(got) >= 0.97 * len(want)
    assert Counter(r.item_id for r in found if r.doc_id == 501)[3] == 2
    for r in found:
        w = plain(next(t for i, t, _ in items if i == r.item_id))
        own = plain(next(d[1] for d in docs if d[0] == r.doc_id))[r.start_word : r.start_word + r.n_words]
        assert nearest(w, own) == r.distance


def test_blocks_of_items_and_dropping(spark, monkeypatch):
    items, docs = planted()
    bench, table = spark.createDataFrame(items, ITEMS), documents(spark, docs)
    whole = {(r.doc_id, r.item_id) for r in D.find_leaks(table, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(table, bench).collect()} == whole
    kept = D.drop_leaks(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d[0] for d in docs} - {d for d, _ in whole})


def test_nothing(spark):
    items, docs = planted()
    none = spark.createDataFrame([], ITEMS)
    assert D.find_leaks(documents(spark, docs), none).count() == 0
    assert D.drop_leaks(documents(spark, docs), none).count() == len(docs)
    assert D.find_leaks(documents(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
