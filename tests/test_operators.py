import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import alignment, folds
from tidemark.operators import intervals as I

times = st.floats(0, 20).map(lambda x: round(x, 2))


def clip(spark, rows, columns="i int, s double, e double"):
    return spark.createDataFrame([("c", *r) for r in rows], f"clip string, {columns}")


def test_gap_fill_and_monotone(spark):
    order = I.by("clip", "i")
    cards = clip(spark, [(0, 0.0, 1.0), (1, 1.5, 2.0), (2, 9.0, 10.0)])
    got = cards.select("i", I.gap_filled(F.col("s"), F.col("e"), F.lit(12.0), order).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [1.5, 5.0, 12.0]
    s, e = I.monotone(F.col("s"), F.col("e"), order)
    got = clip(spark, [(0, 1.0, 2.0), (1, 1.5, 1.8), (2, 0.5, 3.0)]).select("i", s.alias("s"), e.alias("e")).orderBy("i").collect()
    assert [(r.s, r.e) for r in got] == [(1, 2), (2, 2), (2, 3)]


def test_monotone_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [(k, rng.random() * 9, rng.random() * 9) for k in range(60)]
    s, e = I.monotone(F.col("s"), F.col("e"), I.by("clip", "i"))
    got = [(r.s, r.e) for r in clip(spark, rows).select("i", s.alias("s"), e.alias("e")).orderBy("i").collect()]
    last, want = 0.0, []
    for _, a, b in rows:
        a = max(a, last)
        b = max(b, a)
        last = max(last, a, b)
        want.append((a, b))
    assert got == want


def test_clip_to_silence(spark):
    cards = spark.createDataFrame([("c", 1, 0.0, 5.0)], "clip string, card int, s double, e double")
    quiet = spark.createDataFrame([("c", 2.0, 4.0), ("c", 1.0, 1.5), ("c", 4.5, None)], "clip string, s double, e double")
    assert I.clipped(cards, quiet, "clip", 0.5).first().e == 1.0


def subtract_loop(s, e, windows):
    for a, b in windows:
        if s >= a and e <= b:
            return None
        if a <= s < b:
            s = b
        elif a < e <= b or (s < a and e > b):
            e = a
    return (s, e) if e - s >= 0.2 else None


def test_subtract_in_order(spark):
    rng = random.Random(4)
    cases = [((0.0, 10.0), [(2.0, 3.0)]), ((2.5, 10.0), [(2.0, 3.0)]), ((2.1, 2.9), [(2.0, 3.0)])]
    cases += [((a := rng.random() * 9, a + rng.random() * 6), [(b := rng.random() * 12, b + rng.random() * 3) for _ in range(rng.randrange(5))]) for _ in range(200)]
    rows = [(k, s, e, w) for k, ((s, e), w) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, s double, e double, w array<struct<a: double, b: double>>")
    got = df.select("k", I.subtracted(F.col("s"), F.col("e"), F.col("w")).alias("x")).orderBy("k").collect()
    assert [None if r.x is None else tuple(r.x) for r in got] == [subtract_loop(s, e, w) for _, s, e, w in rows]


def test_remap_and_complement(spark):
    cuts = spark.createDataFrame([("c", 13.0, 13.4, 26.98), ("c", 20.88, 21.28, 26.98)], "clip string, s double, e double, end double")
    points = spark.createDataFrame([("c", k, t) for k, t in enumerate([13.80, 20.78, 21.57, 26.60])], "clip string, id int, t double")
    got = [round(r.t_new, 2) for r in I.remapped(points, cuts, "clip").orderBy("id").collect()]
    assert got == [13.40, 20.38, 20.77, 25.80]
    assert [(r.s, r.e) for r in I.complement(cuts, "clip", "end").orderBy("s").collect()] == [(0.0, 13.0), (13.4, 20.88), (21.28, 26.98)]


def test_next_after(spark):
    points = spark.createDataFrame([("c", k, t) for k, t in enumerate([0.0, 2.0, 2.5, 9.0])], "clip string, id long, t double")
    marks = spark.createDataFrame([("c", 7, 2.0), ("c", 5, 2.0), ("c", 8, 4.0)], "clip string, mark long, mt double")
    got = {r.id: (r.mark, r.mark_t) for r in I.next_after(points, marks, "clip").collect()}
    assert got == {0: (5, 2.0), 1: (5, 2.0), 2: (8, 4.0), 3: (None, None)}


def test_spacing_and_cards(spark):
    rng = random.Random(6)
    for _ in range(8):
        t = sorted(round(rng.random() * 30, 1) for _ in range(rng.randrange(20)))
        want = []
        for x in t:
            if not want or x - want[-1] >= 3:
                want.append(x)
        assert spark.range(1).select(folds.spaced(F.lit(t).cast("array<double>"), 3.0).alias("v")).first().v == want
        words, at = [], 0.0
        for _ in range(rng.randrange(20)):
            words.append((at, at + 0.3))
            at += 0.3 + rng.choice([0.0, 0.1, 0.6])
        sizes, n = [], 0
        for k, (_, e) in enumerate(words):
            n += 1
            last = k == len(words) - 1
            if n >= 7 or last or (n >= 3 and words[k + 1][0] - e > 0.35):
                sizes.append(n)
                n = 0
        df = spark.createDataFrame([(words,)], "w array<struct<s: double, e: double>>")
        assert df.select(folds.carded(F.col("w")).alias("v")).first().v == sizes


def best_first(rows, fits):
    """Per clip, the intervals taken best first where fits(taken, interval) holds."""
    taken = {}
    for c, i, s, e, score in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        own = taken.setdefault(c, [])
        if fits([(a, b) for _, a, b in own], s, e):
            own.append((i, s, e))
    return {c: [i for i, _, _ in own] for c, own in taken.items()}


def test_diverse_and_suppressed_with_a_hot_clip(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        s = rng.randrange(0, 3000) / 2
        rows.append((1 if k < 250 else rng.randrange(2, 7), k, s, s + rng.choice([0.0, 0.5, 4.0, 30.0, 120.0]), float(rng.randrange(9))))
    frame = spark.createDataFrame(rows, "clip long, id long, s double, e double, score double")
    long = lambda s, e: max(e - s, 1e-6)
    half = lambda kept, s, e: all(min(e, b) - max(s, a) <= 0.5 * min(long(s, e), long(a, b)) for a, b in kept)
    for keep in (4, 1000):
        got = {}
        for r in folds.diverse(frame, "clip", keep).orderBy("clip", "rank").collect():
            got.setdefault(r.clip, []).append(r.id)
        assert got == {c: ids[:keep] for c, ids in best_first(rows, half).items()}
    room = lambda kept, s, e: sum(max(0.0, min(e, b) - max(s, a)) for a, b in kept) / long(s, e) < 0.5
    got = {}
    for r in folds.suppressed(frame, "clip").orderBy("clip", F.desc("score"), "id").collect():
        got.setdefault(r.clip, []).append(r.id)
    assert got == best_first(rows, room)


def test_sequential_schedule_leaves_no_shared_frame(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        t = 1.0
        for k in range(rng.randrange(1, 8)):
            e = t + rng.random() * 2
            rows.append((f"c{c}", k, t, e))
            t = e + rng.random() * rng.choice([0.1, 1, 3])
    out = I.sequential_schedule(spark.createDataFrame(rows, "clip string, i int, s double, e double"), "clip", 30, 0.45, 0.1, 60.0).orderBy("clip", "i").collect()
    assert len(out) == len(rows) and any(r.hard_cut for r in out)
    for a, b in zip(out, out[1:]):
        if a.clip == b.clip:
            assert a.t_out + a.d_out <= b.t_in - 0.5 / 30 + 1e-9
            assert abs(b.t_in * 30 - round(b.t_in * 30)) < 1e-6
            assert b.hard_cut or a.t_out >= a.t_in + a.d_in - 1e-9
            assert 0.45 + 1e-9 >= a.d_out >= 1 / 30 - 1e-9 and 0.1 - 1e-9 <= b.d_in <= 0.45 + 1e-9


def test_nudges(spark):
    def moved(cards, nudges):
        df = spark.createDataFrame([(cards, nudges)], "c array<struct<s: double, e: double>>, n array<struct<card: int, ds: double, de: double>>")
        return [tuple(x) for x in df.select(folds.nudged(F.col("c"), F.col("n")).alias("v")).first().v]

    cards = [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0)]
    assert moved(cards, [(1, -0.5, 0.5)]) == [(0, 1.5), (1.5, 4.5), (4.5, 6)]
    assert moved(cards, [(1, -0.5, 0.5), (0, 0.0, 1.0)]) == [(0, 2.5), (2.5, 4.5), (4.5, 6)]
    assert moved(cards, []) == cards
    for wrong in ([(0, 2.0, 0.0)], [(3, 0.0, 0.0)], [(-1, 0.0, 0.0)]):
        with pytest.raises(Exception, match="card"):
            moved(cards, wrong)


def test_words_are_drawn_back_to_a_repeat(spark):
    words = spark.createDataFrame([("c", 0, 0.0, 1.0), ("c", 1, 5.0, 6.0), ("d", 0, 0.0, 3.0), ("d", 1, 5.0, 6.0), ("d", 2, 7.0, 8.0)], "clip string, i int, s double, e double")
    repeats = spark.createDataFrame([("c", 4.8, 5.0), ("d", 2.0, 4.0), ("d", 0.0, 6.5), ("d", 1.0, 99.0)], "clip string, first double, second double")
    got = [tuple(r) for r in I.drawn_back(words, repeats, "clip").orderBy("clip", "i").collect()]
    assert got == [("c", 0, 0, 1), ("c", 1, 5, 6), ("d", 0, 0, 2), ("d", 1, 2, 6), ("d", 2, 7, 8)]


def test_boxes(spark):
    box = lambda x, y: {"x": x, "y": y, "w": 10, "h": 10}
    frame = spark.createDataFrame([([box(0, 0), box(5, 5), box(90, 90)], 3)], "boxes array<struct<x:int,y:int,w:int,h:int>>, views int")
    assert [tuple(r) for r in frame.select(F.inline(folds.box_clusters(F.col("boxes"), F.col("views")))).collect()] == [(0, 0, 15, 15, 2)]
    merged = lambda *boxes, pad: folds.merged_boxes(np.array(boxes), pad).tolist()
    assert merged((0, 0, 10, 10), (12, 0, 10, 10), (100, 100, 5, 5), pad=4) == [[0, 0, 22, 10], [100, 100, 5, 5]]
    # the union of the first two comes near the third, which neither does alone
    assert merged((0, 0, 10, 10), (8, 30, 10, 10), (12, 12, 4, 20), (40, 18, 2, 2), pad=4) == [[0, 0, 18, 40], [40, 18, 2, 2]]
    assert folds.merged_boxes(np.empty((0, 4))).shape == (0, 4)


def test_dips_and_cards():
    t = [k * 0.01 for k in range(400)]
    db = [0.0 if 100 <= k < 160 else 60.0 if k != 250 else 45.0 for k in range(400)]
    found = folds.dips(pd.DataFrame({"t": t, "db": db}), 60.0, 10.0, 200, 30.0, 0.3)
    assert [(round(d.t, 2), d.pause, round(d.prom), round(d.t1, 2), round(d.t0, 2)) for d in found.itertuples()] == [(1.29, True, 60, 0.99, 1.6), (2.5, False, 15, 2.49, 2.51)]
    assert folds.dips(pd.DataFrame({"t": [], "db": []}), 60.0, 10.0, 5, 30.0, 0.3).empty
    assert list(folds.dips(pd.DataFrame({"t": [0.0, 0.05, 0.1, 0.15, 0.2], "db": [60.0, 20, 50, 10, 60]}), 60.0, 10.0, 5, 30.0, 0.3)["db"]) == [10.0]
    words = pd.DataFrame({"s": [k * 1.0 for k in range(9)], "e": [k + 0.9 for k in range(9)], "key": 0, "gap": None, "depth": None, "pause": False})
    gaps = words.copy()
    gaps.loc[[2, 4, 6], ["gap", "depth"]] = [[2.95, 9.0], [4.95, 20.0], [6.95, 5.0]]
    gaps["gap"], gaps["depth"] = gaps["gap"].astype(float), gaps["depth"].astype(float)
    gaps.loc[4, "pause"] = True
    cards = lambda w, *limits: [(int(own.index[0]), int(own.index[-1])) for _, own in folds.split_cards(w, folds.CardLimits(*limits)).groupby("card")]
    assert cards(gaps, 4, 99.0) == [(0, 2), (3, 4), (5, 6), (7, 8)] or cards(gaps, 4, 99.0) == [(0, 2), (3, 4), (5, 8)]
    keyed = words.assign(key=[0] * 3 + [1] * 6, gap=float("nan"), depth=float("nan"))
    assert cards(keyed, 99, 99.0) == [(0, 2), (3, 8)] and cards(keyed, 2, 99.0) == [(0, 2), (3, 8)]


def test_global_alignment_scores_best():
    skel = lambda w: "".join(c for c in w if c not in "aeiou") or w
    assert alignment.global_pairs(["a", "b", "c"], ["a", "x", "c"], skel) == [(0, 0), (2, 2)]
    assert alignment.global_pairs(["banana"], ["bonono"], skel) == [(0, 0)]
    assert alignment.global_pairs([], ["a"], skel) == []


def heard(ref, order):
    return [ref[k] for k in order]


def test_restarts():
    ref = [f"word{k}x{k * 7 % 10}" for k in range(14)]
    same = lambda a, b: float(a == b)
    events, restarts = alignment.with_restarts(ref, heard(ref, [*range(9), *range(5, 14)]), same)
    assert [(a, b) for _, a, b in restarts] == [(8, 5)]
    assert sorted(r for _, r, _ in events) == sorted([*range(9), *range(5, 14)])
    n = len(ref)
    _, restarts = alignment.with_restarts(ref, heard(ref, [*range(n)] * 3), same)
    assert [(a, b) for _, a, b in restarts] == [(n - 1, 0)] * 2
    events, restarts = alignment.with_restarts(ref, heard(ref, [0, *range(n)]), same)
    assert not restarts and len(events) == n
    _, restarts = alignment.with_restarts(ref, heard(ref, [k for k in range(n) if not 4 <= k < 9]), same)
    assert not restarts


def test_refrains_are_not_restarts():
    refrain = ["which", "of", "the", "favours"]
    ref = []
    for k in range(6):
        ref += [f"line{k}a", f"line{k}b", *refrain]
    for drop in ([], [6, 7, 8], list(range(8, 14))):
        _, restarts = alignment.with_restarts(ref, [w for k, w in enumerate(ref) if k not in drop], lambda a, b: float(a == b))
        assert not restarts


def test_price_of_going_back():
    for d in range(1, 200):
        assert alignment.back_cost(d) > alignment.SKIP
        assert d < 2 or alignment.back_cost(d) < (1 + alignment.EXTRA) * d


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_weighted_lcs_is_best(a, b):
    weighed = [(x, {"a": 1.0, "b": 0.15, "c": 1.0}[x]) for x in a]
    pairs = alignment.weighted_lcs(weighed, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = {}

    def top(i, j):
        if i == len(a) or j == len(b):
            return 0.0
        if (i, j) not in best:
            best[i, j] = max(top(i + 1, j), top(i, j + 1), top(i + 1, j + 1) + weighed[i][1] if a[i] == b[j] else 0.0)
        return best[i, j]

    got = sum(weighed[i][1] for i, _ in pairs)
    assert got == pytest.approx(top(0, 0))


def test_texts_are_dealt_out_by_number(spark, monkeypatch):
    """A task's texts stay so many at any size of table, also where the table's parts are as many as the cores but hold them unevenly."""
    from tidemark.operators import search

    monkeypatch.setattr(search, "ROWS_A_TASK", 50)
    uneven = spark.range(1000).repartition(8, F.lit(1)).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    sizes = uneven.transform(search.spread).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 100
    few = spark.range(10).transform(search.spread)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and few.count() == 10
