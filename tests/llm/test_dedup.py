import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import hashed_words as H
from tidemark.llm import jaccard_join, substring_dedup
from tidemark.llm.components import components

from .cases import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
def test_rolling_and_sliding(values, size):
    x = np.array(values, np.uint64)
    h = H.rolling(x, size)
    assert len(h) == max(0, len(values) - size + 1)
    runs = [tuple(values[i : i + size]) for i in range(len(h))]
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (runs[i] == runs[j])
    assert H.sliding_min(x, size).tolist() == [min(values[i : i + size]) for i in range(len(values) - size + 1)]


def test_substring_dedup_against_brute_force(spark):
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_duplicates(documents(spark)).collect())
    seen, want = {}, Counter()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, 0 if r[0] is not None else __import__("zlib").crc32((r[1] or "").encode())))
    for doc, text, *_ in ordered:
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - 19):
            run = tuple(w[k : k + 20])
            first = seen.setdefault(run, (doc, text, k))
            if first != (doc, text, k):
                gone.update(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == want
    assert any(k[2] for k in got)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.remove_duplicates(documents(spark, [])).count() == 0


def brute_components(data, size, percent):
    """(doc_id, n, component) as the docstring of link_classes defines them."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc, text, *_ in data:
        w = WORD.findall((text or "").translate(fold))
        sets.append((doc, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    last = lambda d: (d is None, d or 0)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)), key=last)
                root[q] = p
    return Counter((d, len(x), find(d) if x else d) for d, x in sets)


def test_jaccard_join_against_brute_force(spark):
    for size, percent in ((3, 90), (5, 80), (2, 60)):
        got = jaccard_join.link_classes(documents(spark), size, percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows(), size, percent)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    data = []
    for k in range(150):
        copy = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 7)):
            copy[p] = f"x{rng.integers(0, 10**6)}"
        data.append((k, " ".join(copy), "en", "s", 1, *["z"] * 10))
    got = jaccard_join.link_classes(documents(spark, data)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(data, 3, 90)


def test_keep_one(spark):
    kept = jaccard_join.keep_one(documents(spark), 3, 90)
    assert kept.columns == documents(spark).columns
    groups = defaultdict(set)
    for (doc, n, component), _ in brute_components(rows(), 3, 90).items():
        groups[component if n else (doc, "empty")].add(doc)
    assert Counter(r.doc_id for r in kept.collect() if r.text and r.text.strip()) == Counter(g for g in groups if not isinstance(g, tuple))
    assert jaccard_join.keep_one(documents(spark, []), 3, 90).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)}


def test_factors_follow_one_source_and_are_compared_word_by_word():
    flagged = [(9, 0, p, 1, 0, p + 100) for p in (3, 4, 5)] + [(9, 0, 6, 2, 0, 7), (9, 0, 8, 2, 0, 9), (9, 0, 4, 7, 0, 1), (10, 0, 9, 2, 0, 10)]
    rows = [np.array(c, np.int64) for c in zip(*flagged)]
    found = list(zip(*(c.tolist() for c in substring_dedup.parsed(rows, 20))))
    assert found == [(9, 0, 3, 22, 1, 0, 103), (9, 0, 6, 20, 2, 0, 7), (9, 0, 8, 20, 2, 0, 9), (10, 0, 9, 20, 2, 0, 10)]
    words = [b"%d" % k for k in range(50)]
    assert substring_dedup.equal_runs(words, b" ".join(words), 20) == [(0, 50)]
    assert substring_dedup.equal_runs(words, b" ".join([*words[:25], b"x", *words[26:]]), 20) == [(0, 25), (26, 50)]
    assert substring_dedup.equal_runs(words[:22], b" ".join([*words[:10], b"x", *words[11:22]]), 20) == []


def test_texts_without_key_whose_crc_is_the_same(spark):
    import zlib

    rng = np.random.default_rng(11)
    copied = [f"c{k}" for k in rng.integers(0, 10**6, 26)]
    seen: dict[int, str] = {}
    while True:
        text = " ".join([*copied[:25], f"x{rng.integers(0, 10**9)}"])
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    got = substring_dedup.remove_duplicates(documents(spark, [(None, t, "en", "s", 1, *["z"] * 10) for t in (text, other)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 25]


def test_columns_named_like_our_own(spark):
    from tidemark.llm import personal_data, text_stats

    names = ["key", "tag", "KEY_", "__key", "__tag", "__w", "__l", "by_word", "By_Line", "component", "times", "first", "text of", personal_data.KEY]
    docs = documents(spark).select("doc_id", "text", *(__import__("pyspark").sql.functions.lit(k).alias(c) for k, c in enumerate(names)))
    kept = jaccard_join.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(range(len(names)))}
    assert kept.count() == jaccard_join.keep_one(documents(spark), 3, 90).count()
    counted = text_stats.with_stats(docs)
    assert {tuple(r)[2 : 2 + len(names)] for r in counted.collect()} == {tuple(range(len(names)))}
    patterns = spark.createDataFrame([("no such pattern",)], "pattern string")
    assert {tuple(r)[2 : 2 + len(names)] for r in personal_data._with_patterns(docs, patterns).collect()} == {tuple(range(len(names)))}
