import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_dedup, suffix_sort

from .cases import documents, rows


def brute(data, window=50):
    """(doc_id, bytes, removed, runs, sha256) of every row as the contract says; a null key is the smallest."""
    least = {}
    rank = lambda k: -(2**63) if k is None else k
    for key, text, *_ in data:
        raw = (text or "").encode()
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            least[w] = min(least.get(w, rank(key)), rank(key))
    out = Counter()
    for key, text, *_ in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if least[raw[k : k + window]] < rank(key):
                gone[k : k + window] = b"\x01" * window
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(spark, data, **how):
    got = suffix_dedup.remove_shared(documents(spark, data), **how).collect()
    assert all(r.n_removed == sum(r.spans[1::2]) - sum(r.spans[::2]) for r in got if r.spans)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)


def of(texts, keys=None):
    return [(k, t, "en", "s", 1, *["z"] * 10) for k, t in zip(keys or range(len(texts)), texts)]


def test_against_brute_force(spark):
    assert found(spark, rows()) == brute(rows())
    assert found(spark, rows(seed=8, n=30), window=30, anchor=12) == brute(rows(seed=8, n=30), 30)


def test_hard_texts(spark):
    rng = random.Random(2)
    letters = "".join(rng.choice("ab") for _ in range(4000))
    texts = [
        "a" * 3000,
        "a" * 49,
        "a" * 50,
        "ab" * 700,
        "abc" * 500,
        "ba" * 300,
        letters,
        letters[100:3000] + "é" * 80 + letters[:500],
        "é" * 60 + "ü" * 60,
        "\x00" * 120,
        "\x00" * 80 + "x",
        "😀" * 40,
        "x" + "😀" * 13,  # shares windows that begin inside a character
        letters + letters,
        "".join(rng.choice("ab") for _ in range(4000)) + letters[7:70],
    ]
    assert found(spark, of(texts)) == brute(of(texts))
    backwards = of(texts, [*range(len(texts) - 1, -1, -1)])
    assert found(spark, backwards) == brute(backwards)
    assert len({r[1] for r in backwards}) == len(texts)


def test_keys_and_repeats(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    other = text[:200] + "z" * 30 + text[150:]
    keys = [None, None, 4, 4, 4, 2**63 - 1, -(2**63) + 1, 7]
    data = of([text, other, text, other, text, text, other, "q" * 20 + text[100:180]], keys)
    assert found(spark, data) == brute(data)
    assert found(spark, data[2:]) == brute(data[2:])
    assert found(spark, []) == Counter()
    assert found(spark, of([None, "", "short"])) == brute(of([None, "", "short"]))


def test_many_copies_and_a_very_long_text(spark):
    rng = random.Random(9)
    hot = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    texts = [hot] * 400 + [hot[k : k + 120] + f" {k} " + hot[: 40 + k] for k in range(200)]
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(330_000))
    texts += [long[1_000_000:1_200_000], "tail " + long[-60:], long]
    data = of(texts, rng.sample(range(10_000), len(texts)))
    assert len(long) > 2 * suffix_dedup.LOT
    assert found(spark, data) == brute(data)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=40), min_size=1, max_size=8), st.integers(8, 20), st.booleans())
def test_sorted_suffixes(texts, depth, weak):
    """Also where the only base makes nearly all hashes collide."""
    raw = [t.encode() for t in texts if len(t) >= depth]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(sizes) - sizes
    suffixes = np.array([int(b) + k for b, r in zip(begin, raw) for k in range(len(r) - depth + 1)], np.int64)
    order, equal = suffix_sort.sort(data, suffixes, depth, (1,) if weak else suffix_sort.BASES)
    prefix = [data[k : k + depth].tobytes() for k in order.tolist()]
    assert prefix == sorted(prefix) and sorted(order.tolist()) == suffixes.tolist()
    assert equal.tolist() == [k > 0 and prefix[k] == prefix[k - 1] for k in range(len(prefix))]


def test_equal_suffixes_are_sorted_once(monkeypatch):
    rng = random.Random(3)
    data = np.frombuffer(("".join(rng.choice("abcd") for _ in range(60)) * 50).encode(), np.uint8)
    moved = []
    monkeypatch.setattr(suffix_sort, "merged", lambda order, *a, f=suffix_sort.merged: moved.append(len(order)) or f(order, *a))
    order, equal = suffix_sort.sort(data, np.arange(len(data) - 49), 50)
    assert (~equal).sum() == 60 and len(order) == len(data) - 49 and moved == [0]  # 60 different windows, none of which share sixteen bytes


def test_rows_dealt_follow_the_places_not_the_lots():
    """A lot of texts had a row for each block of anchors, so rows grew with the lots times the blocks."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abcdefgh ", k=1 << 20)).decode() for _ in range(10)]
    table = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array([0] * 10, pa.int64()), pa.array(texts)], names=["key", "tag", "text"])
    rows = [b for k in range(10) for b in [table.slice(k, 1)]]
    dealt = list(suffix_dedup.anchor_places(64)(iter(rows)))
    assert sum(b.num_rows for b in dealt) == 64  # ten lots were five times as many rows at least, with the same places
    assert {k for b in dealt for k in b.column("block").to_pylist()} == set(range(64))


def test_common_extensions():
    data = np.frombuffer(b"the same beginning, then not" + b"the same beginning, thus so", np.uint8)
    e = suffix_sort.Extensions(data, suffix_sort.BASES[0], 24)
    assert e.common(np.array([0, 4]), np.array([28, 32]), 8, 23).tolist() == [22, 18]
    assert e.less(np.array([0, 28]), np.array([28, 0]), 8, 24).tolist() == [True, False]


def test_pieces_cover_each_window_once():
    texts = ["", "x" * 30, "y" * 105, "z" * 9, "w" * 48]
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = Counter((int(r), int(o) + k) for s, row, offset in suffix_dedup.pieces(rows, 10, 20) for r, o, n in zip(row, offset, s.sizes) for k in range(int(n) - 9))
    assert got == Counter((r, k) for r, t in enumerate(texts) for k in range(len(t) - 9))


def test_a_block_keeps_only_what_the_smallest_ids_hold():
    text = bytes(range(60, 124))
    block, flagged = suffix_dedup.Block(50), []
    for key in (5, 9, 3, 7, 3):
        block.add(suffix_dedup.bundled(np.array([64]), text, [np.array([0]), np.array([key]), np.array([1]), np.array([0])]))
        flagged.append([f.tolist() for f in block.sort()])
    none = [[], [], [], []]
    assert flagged == [none, [[9], [1], [0], [15]], [[5], [1], [0], [15]], [[7], [1], [0], [15]], none]
    assert list(block.ids) == [text] and block.entries[0][1].tolist() == [3]
