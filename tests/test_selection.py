import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import folds
from tidemark.operators import intervals as I
from tidemark.operators import lookup as L
from tidemark.operators import search as S
from tidemark.operators import selection as C

LETTERS = "bcdfghklmnprst"


def corpus(seed=7, chapters=14, verses=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    return rng, [(c, "".join(say(rng.randrange(4, 12)).capitalize() + rng.choice([". ", "!\n", "? "]) for _ in range(verses))) for c in range(chapters)]


def brute(items, docs, most=L.VERSES):
    """Every item with every window of every chapter."""
    norm = lambda t: " ".join(w for w in __import__("re").split("[^a-z0-9]+", t.lower()) if w)
    out = {}
    for item, text in items:
        found = []
        for doc, body in docs:
            own = [v for v in map(norm, __import__("re").split(r"[.!?\n]+", body)) if v]
            for a in range(len(own)):
                for b in range(a, min(len(own), a + most)):
                    found.append((-round(SequenceMatcher(None, norm(text), " ".join(own[a : b + 1])).ratio(), 4), doc, a, b))
        out[item] = min(found)
    return out


def test_passages_of_items_edited_at_their_beginning(spark):
    rng, docs = corpus()
    items = []
    for k in range(12):
        doc, body = rng.choice(docs)
        parts = [p for p in body.replace("!\n", ". ").replace("? ", ". ").split(". ") if p]
        at = rng.randrange(len(parts) - 3)
        words = " ".join(parts[at : at + 1 + k % 3]).split()
        words[0], words[1] = words[0].upper() + "xx", "wholly other words " + words[1][::-1]  # the first words edited and in capitals
        if k % 2:
            del words[len(words) // 2]
        items.append((k, " ".join(words) if k % 4 else " ".join(words).upper()))
    items.append((99, "zzzz yyyy"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "query long, text string")
    tokens = i.select("query", F.posexplode(T.words(F.col("text"))).alias("qi", "token"))
    hits, _ = S.matches(S.worded(d, "doc_id", T.words), tokens, T.skeleton, len(docs))
    got = L.matched(i, d, hits).collect()
    want = brute(items, docs)
    first = {r.query: (-r.ratio, r.doc, r.verse_from, r.verse_to) for r in got if r["rank"] == 1}
    assert first == {k: v for k, v in want.items() if k != 99}
    assert all(r.verse_to - r.verse_from < L.VERSES and r.verse_to < 12 for r in got)
    assert all(n <= 3 for n in Counter(r.query for r in got).values())


def test_common_words_vote_for_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]  # each has more postings than a search's words may have
    docs = [(k, ". ".join(" ".join(rng.choices(vocabulary, k=rng.randrange(3, 12))) for _ in range(1300))) for k in range(15)] + [(15, None), (16, "w1"), (17, "... !")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    said = [" ".join(docs[k][1].split(". ")[a : a + 3]) for k, a in ((3, 0), (7, 1297), (11, 40))]
    i = spark.createDataFrame([*enumerate(said), (3, "w1x w2"), (4, "zz")], "query long, text string")
    tokens = i.select("query", F.posexplode(T.words(F.col("text"))).alias("qi", "token"))
    words = S.worded(d, "doc_id", T.words)
    assert not S.matches(words, tokens, T.skeleton, len(docs))[0].where("query < 3").count()
    voted = L.cells_voted(words, S.forms_asked(words, tokens, T.skeleton))
    want = []
    norm = lambda t: __import__("re").findall("[a-z0-9]+", (t or "").lower())
    for q, asked in enumerate(said):
        for doc, text in docs:
            own, at = norm(text), {}
            for qi, word in enumerate(norm(asked)):
                for pos, w in enumerate(own):
                    if w == word:
                        for cell in ((pos - qi) // L.STEP, (pos - qi) // L.STEP - 1):
                            at.setdefault(cell, set()).add(qi)
            want += [(q, -len(v), doc, cell) for cell, v in at.items() if len(v) >= 2]
    want = {(q, doc, cell, -votes, 1 + k) for n in range(len(said)) for k, (q, votes, doc, cell) in enumerate(sorted(x for x in want if x[0] == n)[: L.CELLS])}
    assert {tuple(r) for r in voted.where("query < 3").select("query", "doc", "cell", "votes", "rank").collect()} == want
    first = {r.query: (r.ratio, r.doc, r.verse_from) for r in L.compared(i, d, voted).where("rank = 1").collect()}
    assert all(first[k] == (1.0, doc, verse) for k, doc, verse in ((0, 3, 0), (1, 7, 1297), (2, 11, 40))) and 4 not in first


def test_windows_end_with_their_chapter(spark):
    d = spark.createDataFrame([(1, "One two. Three! Four five six"), (2, "... !"), (3, None)], "doc_id long, text string")
    rows = {(r.doc, r.verse): (r.begin, r.end, [list(w) for w in r.ahead]) for r in L.windows(L.verses(d), 2).collect()}
    one, two, three = ["one", "two"], ["three"], ["four", "five", "six"]
    assert rows == {(1, 0): (0, 2, [one, two]), (1, 1): (2, 3, [two, three]), (1, 2): (3, 6, [three])}


def intervals(seed, n, hot):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = rng.randrange(0, 2000) / 4
        out.append((1 if k < hot else rng.randrange(2, 6), k, s, s + rng.choice([0.0, 0.25, 3.0, 40.0, 333.0])))
    return out


def test_overlaps_with_a_hot_key(spark):
    left, right = intervals(1, 120, 50), intervals(2, 150, 60)
    l, r = spark.createDataFrame(left, "u long, id long, s double, e double"), spark.createDataFrame(right, "u long, other long, os double, oe double")
    want = Counter((a[0], a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[0] == b[0] and min(a[3], b[3]) > max(a[2], b[2]))
    assert Counter((x.u, x.id, x.other, x.overlap) for x in C.overlapping(l, r, ["u"], 16.0).collect()) == want
    by = defaultdict(list)
    starts = {b[1]: b[2] for b in right}
    for u, a, b, o in want:
        by[a].append((-o, starts[b], b))
    got = {x.id: (x.other, x.overlap) for x in C.best_overlap(l, r, ["u"], 16.0).collect()}
    assert got == {a[1]: (min(by[a[1]])[2], -min(by[a[1]])[0]) if by[a[1]] else (None, None) for a in left}


def test_weighted_mode(spark):
    ranges = spark.createDataFrame([(1, 10, 0.0, 5.0), (1, 11, 50.0, 60.0), (2, 12, 0.0, 9.0)], "u long, id long, s double, e double")
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0, "a", 3), (1, 2, 2.0, 3.0, "b", 2), (1, 3, 4.0, 8.0, "b", 2), (1, 4, 5.0, 6.0, "a", 9), (2, 5, 1.0, 2.0, "d", 4), (2, 6, 1.0, 2.0, "c", 4)], "u long, other long, os double, oe double, label string, words long")
    got = sorted(tuple(r) for r in C.weighted_mode(ranges, rows, ["u"], "label", "words", 2.0).collect())
    assert got == [(1, 10, "b", 4, 2, 2, 3), (2, 12, "c", 4, 1, 6, 6)]


def test_rejudged(spark):
    every = [(1, 1, "a", 0.0, 9.0, 1.0), (1, 2, "b", 5.0, 9.0, 0.95), (1, 3, "c", 1.0, 8.0, 0.9), (1, 4, "c", 7.0, 30.0, 0.5), (1, 5, "d", 0.0, 4.0, 0.7), (1, 6, "e", 40.0, 50.0, 0.6)]
    verdicts = [(1, False, "c"), (2, True, None), (3, True, None), (4, True, None), (5, False, "e"), (6, False, None)]
    e = spark.createDataFrame(every, "clip long, id long, label string, s double, e double, score double")
    v = spark.createDataFrame(verdicts, "id long, stands boolean, wanted string")
    pool = e.where("id in (1, 2, 3, 5)").withColumn("rank", F.expr("case id when 1 then 1 when 2 then 2 when 3 then 3 else 4 end"))
    got = sorted(((r["rank"], r.id, r.score, r.state, r.from_id) for r in C.rejudged(pool, e, v, "clip", 4.0).collect()))
    # 1 becomes 3, which the old 3 is then alike to; 5 wants a candidate that it shares no time with
    assert got == [(1, 2, 0.95, "stands", None), (2, 3, 0.9, "adjusted", 1), (3, 5, 0.56, "lowered", None)]
    unjudged = C.rejudged(pool, e, v.where("id = 3"), "clip", 4.0).collect()
    assert {r.state for r in unjudged} == {"unjudged", "stands"} and [r["rank"] for r in unjudged] == [1, 2, 3, 4]


def test_holes_are_filled_where_time_advances(spark):
    rows = [(1, 1, 0.0, 1.0), (1, 2, 1.0, 2.0), (1, 5, 8.0, 9.0), (1, 7, 8.5, 10.0), (1, 12, 20.0, 21.0), (1, 10, 30.0, 31.0), (2, 3, 0.0, 1.0)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "clip long, ref long, t0 double, t1 double, k int")
    got = sorted((r.clip, r.t0, r.ref, r.t1) for r in I.holes_filled(frame, "clip", I.by("clip", "k")).where("not measured").collect())
    assert got == [(1, 2.0, 3, 4.0), (1, 4.0, 4, 6.0)]
    assert I.holes_filled(frame, "clip", I.by("clip", "k")).where("measured").count() == len(rows)


def test_coarse_run_is_scanned_finely(spark):
    rows = [(1, float(t), 0.0 if 100 <= t < 130 or 203 <= t < 226 or t == 231 else 50.0) for t in range(400)]
    rows += [(2, float(t), 50.0) for t in range(50)]
    frame = spark.createDataFrame(rows, "clip long, t double, level double")
    got = I.coarse_to_fine(frame, "clip", 10.0, 12.0, 40.0, 60.0, 10.0).collect()
    assert [tuple(r) for r in got] == [(1, 100.0, 120.0, 100.0, 129.0)]


def test_hits_follow_each_other_however_keys_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a river ran by the river ran"), (2, "ran river"), (3, ""), (4, None)], "doc_id long, text string")
    tokens = spark.createDataFrame([(7, 0, "river"), (7, 1, "ran"), (7, 2, "nowhere"), (8, 0, "rover")], "query long, qi int, token string")
    got = []
    for most in (S.BROADCAST_ROWS, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", most)
        hits, totals = S.matches(S.worded(docs, "doc_id", T.words), tokens, T.skeleton, 4)
        got.append((sorted(hits.select("query", "qi", "doc", "pos", "follows").collect()), S.ranked(hits, totals, 3).collect()))
    assert got[0] == got[1]
    # "rover" is nowhere, and found by its skeleton.
    assert [tuple(r) for r in got[0][0] if r["query"] == 7] == [(7, 0, 1, 1, True), (7, 0, 1, 5, True), (7, 0, 2, 1, False), (7, 1, 1, 2, False), (7, 1, 1, 6, False), (7, 1, 2, 0, False)]
    assert {r["doc"] for r in got[0][0] if r["query"] == 8} == {1, 2}
    assert [(r["doc"], r["hits"]) for r in got[0][1] if r["query"] == 7] == [(1, 2), (2, 2)]


def test_passes_and_bins_with_a_hot_clip(spark):
    rng = random.Random(12)
    clip = lambda: "hot" if rng.random() < 0.4 else f"c{rng.randrange(30)}"
    t = lambda: rng.randrange(0, 4000) / 4  # noqa: E731  halves and quarters, so that ends are often equal
    cards = [(clip(), k, a, a + rng.choice([0.0, 0.5, 30.0, 400.0])) for k, a in enumerate(t() for _ in range(500))]
    cuts = [(clip(), a, a + rng.choice([0.0, 0.25, 2.0, 900.0])) for a in (t() for _ in range(400))]
    frame = spark.createDataFrame
    dc, dx = frame(cards, "u string, card int, s double, e double"), frame([*cuts, ("hot", 5.0, None)], "u string, s double, e double")
    got = {r.card: r.e for r in I.clipped(dc, dx, "u", 1.0).collect()}
    assert got == {k: min((a for v, a, b in cuts if v == u and b - a >= 1 and s < a < e), default=e) for u, k, s, e in cards}
    got = {r.id: r.t_new for r in I.remapped(dc.select("u", F.col("card").alias("id"), F.col("e").alias("t")), dx, "u").collect()}
    assert got == {k: e - sum(b - a for v, a, b in cuts if v == u and b <= e) for u, k, s, e in cards}
    marks = dx.select("u", F.monotonically_increasing_id().alias("mark"), F.col("s").alias("mt"), (F.col("s") % 3).alias("depth"))
    known = marks.collect()
    got = {r.id: r.mark for r in I.nearest(dc.select("u", F.col("card").alias("id"), F.col("s").alias("t")), marks, "u", 7.5).collect()}
    want = {k: min(((-m.depth, abs(m.mt - s), m.mark) for m in known if m.u == u and abs(m.mt - s) <= 7.5), default=None) for u, k, s, _ in cards}
    assert got == {k: w[2] for k, w in want.items() if w}
    pairs = C.meeting(dc, dx.select("u", F.col("s").alias("os"), F.col("e").alias("oe")), ["u"], 50.0).select("card", "os", "oe").collect()
    assert sorted(map(tuple, pairs)) == sorted((k, a, b) for u, k, s, e in cards for v, a, b in cuts if u == v and s <= b and a <= e)
    taken = sorted(map(tuple, folds.spaced_out(frame([(u, s) for u, _, s, _ in cards] + [("hot", None)], "u string, t double"), "u", "t", 6.0).collect()))
    want = []
    for u, s in sorted((u, s) for u, _, s, _ in cards):
        if not want or want[-1][0] != u or s - want[-1][1] >= 6:
            want.append((u, s))
    assert taken == want
