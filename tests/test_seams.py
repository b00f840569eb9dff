import random

from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import seams


def told(cards, words, n_a, pairs, said, slack=2):
    """The rule for one text, cut by cut."""
    spans = [(c, max(0, min(a, n_a - 1)), max(0, min(b, n_a - 1)) + 1) for c, a, b in cards]
    cuts, n = sorted({x for _, a, b in spans for x in (a, b) if 0 < x < n_a}), len(words)
    if not cuts:
        return {c: (" ".join(words), "whole") for c, _, _ in spans}
    if n <= len(cuts):
        return {c: (" ".join(words), "too short") for c, _, _ in spans}

    def placed(targets):
        out = []
        for i, t in enumerate(targets):
            t = max(t, out[-1] + 1 if out else 1)
            out.append(min(t, n - (len(cuts) - i)))
        return out

    near = [min(((a, b) for a, b in pairs if a >= c), default=None) for c in cuts]
    if said is not None and len(said) == len(cuts) and None not in said and sorted(set(said)) == said and said[0] >= 1 and said[-1] < n:
        at, why = said, "verdict"
    elif all(p is not None and p[0] - c <= slack for p, c in zip(near, cuts)):
        at, why = placed([b for _, b in near]), "anchored"
    else:
        at, why = placed([round(c * n / n_a) for c in cuts]), "proportional"
    edge = {0: 0, n_a: n} | dict(zip(cuts, at))
    return {c: (" ".join(words[edge[a] : edge[b]]), why) for c, a, b in spans}


def test_fragments_follow_the_rule(spark):
    rng = random.Random(11)
    cards, texts, pairs, verdicts, want = [], [], [], [], {}
    for clip in range(240):
        n_a, n = rng.randrange(1, 30), rng.randrange(0, 30)
        words = [f"w{k}" for k in range(n)]
        at = sorted(rng.sample(range(n_a + 1), rng.randrange(0, min(4, n_a + 1))))
        bounds = [0, *at, n_a + 3] if rng.random() < 0.6 else [*at, n_a]
        own = [(k, a, b - 1) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))] or [(0, -2, 99)]
        if rng.random() < 0.2:
            own.append((len(own), own[0][1], own[-1][2]))
        dense = rng.choice([0.4, 0.95])
        met = [(a, min(n - 1, a * n // n_a)) for a in range(n_a) if n and rng.random() < dense]
        said = rng.choice([None, None, sorted(rng.sample(range(1, 30), rng.randrange(1, 5))), [3, 2], [None, 4], []])
        cards += [(clip, *c) for c in own]
        texts.append((clip, words, n_a))
        pairs += [(clip, a, b) for a, b in met] * rng.choice([1, 2])
        verdicts += [(clip, said)] if said is not None else []
        want |= {(clip, c): r for c, r in told(own, words, n_a, met, said).items()}
    cards += [(900, 0, 0, 3), (901, 0, None, 3), (902, 0, 0, 2)]
    texts += [(901, ["a"], 4), (902, ["a", "b"], 0), (903, None, 4), (904, None, 5)]
    cards += [(903, 0, 0, 3), (904, 0, 0, 1), (904, 1, 2, 4)]
    want |= {(903, 0): ("", "whole"), (904, 0): ("", "too short"), (904, 1): ("", "too short")}
    frame = spark.createDataFrame
    got = seams.fragments(
        frame(cards, "u long, card int, w0 int, w1 int"), frame(texts, "u long, words array<string>, n_a int"), frame(pairs, "u long, a int, b int"), frame(verdicts, "u long, cuts array<int>"), "u"
    ).collect()
    assert len(got) == len(want) and {(r.u, r.card): (r.fragment, r.reason) for r in got} == want
    assert {w for _, w in want.values()} == {"whole", "too short", "verdict", "anchored", "proportional"}


def test_no_cards_no_fragments(spark):
    frame = spark.createDataFrame
    got = seams.fragments(frame([], "u long, card int, w0 int, w1 int"), frame([], "u long, words array<string>, n_a int"), frame([], "u long, a int, b int"), frame([], "u long, cuts array<int>"), "u")
    assert got.collect() == []


def test_runs_are_pulled_onto_their_words(spark):
    rng = random.Random(5)
    tokens, runs, spellings, want = [], [], [], {}
    for clip, size in ((0, 400), (1, 30), (2, 1)):  # the first is mostly one word
        say = ["x" if clip == 0 and rng.random() < 0.4 else rng.choice("abcdefgh") + rng.choice("ijk") for _ in range(size)]
        tokens += [(clip, k, w, say[k + 1] if k + 1 < size else None) for k, w in enumerate(say)]
        for run in range(150 if clip == 0 else 12):
            i = rng.randrange(size)
            j = i + rng.randrange(0, 20)
            label = f"{clip}.{run}"
            first = rng.choice([say[i], say[min(i + 9, size - 1)], "".join(say[i : i + 2]), "none", "x"])
            last = rng.choice([say[min(j, size - 1)], say[max(0, i - 5)], "x", "none"])
            runs.append((clip, run, label, i, j))
            spellings += [(label, "first", first), (label, "first", first), (label, "last", last), (label, "last", None)]
            fits = lambda k, word: say[k] == word or (k + 1 < size and say[k] + say[k + 1] == word)
            lo = min((k for k in range(max(0, i - 12), min(size, i + 12)) if fits(k, first)), key=lambda k: abs(k - i), default=i)
            hi = min((k for k in range(max(0, j - 12), min(size, j + 13)) if fits(k, last)), key=lambda k: abs(k - j), default=j)
            want[clip, run] = (lo, hi) if lo <= hi else (i, j)
    runs.append((1, 99, None, 3, 4))
    want[1, 99] = (3, 4)
    frame = spark.createDataFrame
    got = seams.snapped(frame(runs, "u long, run int, label string, i int, j int"), frame(tokens, "u long, pos int, token string, next string"), frame(spellings, "label string, side string, word string"), "u").collect()
    assert len(got) == len(want) and {(r.u, r.run): (r.i, r.j) for r in got} == want
    assert sum(want[u, n] != (i, j) for u, n, _, i, j in runs) > 30


def test_runs_of_a_text_in_one_row_are_pulled_as_those_of_rows(spark):
    rng = random.Random(8)
    texts, runs, tokens, spellings = [], [], [], []
    for clip in range(40):
        words = [rng.choice(["x", "ab", "a", "b", "cd", "c"]) for _ in range(rng.randrange(1, 60))]
        own = []
        for run in range(12):
            i = rng.randrange(0, len(words) + 3)
            own.append((run, i, i + rng.randrange(-9, 15), [rng.choice(["ab", "cd", "x", "none"])], [rng.choice(["b", "xa", "none"]), None]))
        texts.append((clip, words, own))
        tokens += [(clip, k, w, words[k + 1] if k + 1 < len(words) else None) for k, w in enumerate(words)]
        runs += [(clip, r, f"{clip}.{r}", i, j) for r, i, j, _, _ in own]
        spellings += [(f"{clip}.{r}", side, w) for r, _, _, first, last in own for side, ws in (("first", first), ("last", last)) for w in ws]
    frame = spark.createDataFrame
    rows = frame(texts + [(90, None, None), (91, [], [(0, 1, 2, ["x"], ["x"])])], "u long, words array<string>, runs array<struct<run:int,i:long,j:long,first:array<string>,last:array<string>>>")
    got = rows.selectExpr("u", "words", "runs").select("u", F.inline(seams.snapped_within(F.col("words"), F.col("runs"))))
    want = seams.snapped(frame(runs, "u long, run int, label string, i int, j int"), frame(tokens, "u long, pos int, token string, next string"), frame(spellings, "label string, side string, word string"), "u")
    assert {(r.u, r.run): (r.i, r.j) for r in got.collect()} == {(r.u, r.run): (r.i, r.j) for r in want.collect()} | {(91, 0): (1, 2)}


def test_edge_snap_moves_no_words_between_tasks(spark, sf):
    plan = catalogue.queries()["edge_snap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_fragments_of_a_text_in_one_row_follow_the_rule(spark):
    rng = random.Random(23)
    rows, want = [], {}
    for clip in range(400):
        n_a, n = rng.randrange(1, 40), rng.randrange(0, 40)
        words = [f"w{k}" for k in range(n)]
        at = sorted(rng.sample(range(n_a + 1), rng.randrange(0, min(8, n_a + 1))))
        bounds = [0, *at, n_a + 3] if rng.random() < 0.6 else [*at, n_a]
        own = [(k, a, b - 1) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))] or [(0, -2, 99)]
        if rng.random() < 0.2:
            own.append((len(own), own[-1][2], own[0][1]))  # ends before it begins
        rng.shuffle(own)
        dense = rng.choice([0.4, 0.95])
        met = [(a, min(n - 1, a * n // n_a)) for a in range(n_a + 2) if n and rng.random() < dense for _ in range(rng.choice([1, 1, 2]))]
        said = rng.choice([None, None, sorted(rng.sample(range(1, 30), rng.randrange(1, 5))), [3, 2], [None, 4], []])
        slack = clip % 2 * 2
        rows.append((clip, slack, words, n_a, own + [(99, None, 3), (98, 0, None)], [a for a, _ in met], [b for _, b in met], said))
        want |= {(clip, c): r for c, r in told(own, words, n_a, met, said, slack).items()}
    rows += [(900, 2, None, 4, [(0, 0, 3)], [], [], None), (901, 2, None, 5, [(0, 0, 1), (1, 2, 4)], [1], [0], None), (902, 2, ["a"], 0, [(0, 0, 2)], [], [], None), (903, 2, ["a"], None, [(0, 0, 2)], [], [], None), (904, 2, ["a"], 3, [], [], [], None)]
    want |= {(900, 0): ("", "whole"), (901, 0): ("", "too short"), (901, 1): ("", "too short")}
    texts = spark.createDataFrame(rows, "u long, slack int, words array<string>, n_a int, cards array<struct<card:int,w0:int,w1:int>>, a array<int>, b array<int>, said array<int>")
    args = [F.col(c) for c in ("words", "n_a", "cards", "a", "b", "said")]
    got = [r for slack in (0, 2) for r in texts.where(F.col("slack") == slack).select("u", F.inline(seams.fragments_within(*args, slack=slack))).collect()]
    assert len(got) == len(want) and {(r.u, r.card): (r.fragment, r.reason) for r in got} == want
    assert {w for _, w in want.values()} == {"whole", "too short", "verdict", "anchored", "proportional"}
    long = texts.where("slack = 2").select("u", F.inline(seams.fragments_within(*args, made=F.length)))
    assert {(r.u, r.card): r.fragment for r in long.collect()} == {k: len(text) for k, (text, _) in want.items() if k[0] % 2 or k[0] >= 900}


def test_cuts_of_a_long_text_keep_their_room(spark):
    n_a, n = 6000, 2500  # more cuts than every second word can have
    cards = [(k, 3 * k, 3 * k + 2) for k in range(2000)]
    a = [x for x in range(n_a) if x % 3 == 0 or x % 7 == 0]
    b = [min(n - 1, x // 40) for x in a]
    row = spark.createDataFrame([([f"w{k}" for k in range(n)], n_a, cards, a, b)], "words array<string>, n_a int, cards array<struct<card:int,w0:int,w1:int>>, a array<int>, b array<int>")
    got = row.select(F.inline(seams.fragments_within(F.col("words"), F.col("n_a"), F.col("cards"), F.col("a"), F.col("b"), F.lit(None).cast("array<int>")))).collect()
    assert {r.card: (r.fragment, r.reason) for r in got} == told(cards, [f"w{k}" for k in range(n)], n_a, list(zip(a, b)), None)


def test_verse_fragments_moves_no_words_between_tasks(spark, sf):
    plan = catalogue.queries()["verse_fragments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan and plan.count("Exchange") == 1
