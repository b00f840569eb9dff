"""Seams between cards and between runs: where a translation is cut, and where a run's own words begin and end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import by
from .reports import anchored_cuts, spaced


def _numbered(spans: DataFrame, clip: str) -> DataFrame:
    """(clip, i, cut, m, n, n_a): the different places inside a text that its cards begin or end at, numbered, and their number m."""
    inside = (F.col("cut") > 0) & (F.col("cut") < F.col("n_a"))
    cuts = spans.select(clip, "n", "n_a", F.explode(F.array("w0", "past")).alias("cut")).where(inside).distinct()
    i = (F.row_number().over(by(clip, "cut")) - 1).cast("long")
    return cuts.select(clip, i.alias("i"), "cut", F.count("*").over(Window.partitionBy(clip)).alias("m"), "n", "n_a")


def _usable(cuts: Column, m: Column, n: Column) -> Column:
    """Whether a verdict holds m places that ascend and leave a word before, between and after them."""
    ascending = F.array_sort(F.array_distinct(cuts)) == cuts
    bounded = (F.array_min(cuts) >= 1) & (F.array_max(cuts) < n)
    return F.coalesce((F.size(cuts) == m) & ~F.exists(cuts, lambda c: c.isNull()) & ascending & bounded, F.lit(False))


def fragments(cards: DataFrame, texts: DataFrame, pairs: DataFrame, verdicts: DataFrame, clip: str, slack: int = 2) -> DataFrame:
    """(clip, card, fragment, reason): the part of a translation that each card (clip, card, w0, w1) carries, which holds words w0 to w1 of the original.

    texts (clip, words, n_a) is one row a clip: the translation's words and the original's number of words. A card
    over all of a clip, alone in it, has the whole translation ("whole"). Otherwise the translation is cut where cards
    begin and end, all of a clip's cuts in one way: as a verdict (clip, cuts) says, if it names as many places as there
    are cuts, ascending and inside ("verdict"); else at the words that pair with the original's (pairs: clip, a, b),
    if every cut has one within `slack` words ("anchored"); else by share of the words ("proportional"). With
    fewer words than cards nothing can be cut, and every card has the whole translation ("too short"). Words before
    the first card and after the last belong to none.

    Cards that reach past the original are cut to it; one that ends before it begins is empty. Words are joined by
    single blanks; a null list of words is an empty one. Cards without numbers, of a clip without text or of an
    original without words have no row. Repeated pairs count once; of several verdicts the least is taken.
    """
    known = texts.where(F.col("n_a") > 0).select(clip, F.col("n_a").cast("long").alias("n_a"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    sizes = known.select(clip, "n_a", F.size("words").cast("long").alias("n"))
    placed = cards.where(F.col("w0").isNotNull() & F.col("w1").isNotNull()).join(sizes, clip)
    inner = lambda w: F.greatest(F.lit(0).cast("long"), F.least(F.col(w).cast("long"), F.col("n_a") - 1))
    spans = placed.select(clip, "card", "n", "n_a", inner("w0").alias("w0"), (inner("w1") + 1).alias("past"))
    cuts = _numbered(spans, clip)
    share = F.bround(F.col("cut") * F.col("n") / F.col("n_a").cast("double")).cast("long")
    shared = cuts.withColumn("even", spaced(share, clip))
    anchored = anchored_cuts(cuts.select(clip, "i", "cut"), pairs.select(clip, "a", "b").distinct(), sizes.select(clip, "n"), clip, slack).select(clip, "cut", "anchor")
    said = verdicts.groupBy(clip).agg(F.min("cuts").alias("said"))
    offered = shared.join(anchored, [clip, "cut"], "left").join(said, clip, "left")
    usable = _usable(F.col("said"), F.col("m"), F.col("n"))
    at = F.when(usable, F.get("said", F.col("i").cast("int")).cast("long")).otherwise(F.coalesce("anchor", "even"))
    reason = F.when(usable, "verdict").when(F.col("anchor").isNotNull(), "anchored").when(F.col("even").isNotNull(), "proportional").otherwise("too short")
    found = offered.select(clip, F.col("cut"), at.alias("at"), reason.alias("reason"))
    left = found.select(clip, F.col("cut").alias("w0"), F.col("at").alias("from"))
    right = found.select(clip, F.col("cut").alias("past"), F.col("at").alias("to"))
    told = known.select(clip, "words").join(found.groupBy(clip).agg(F.min("reason").alias("reason")), clip, "left")
    cut = spans.join(left, [clip, "w0"], "left").join(right, [clip, "past"], "left").join(told, clip)
    why = F.coalesce("reason", F.lit("whole"))
    first = F.when(F.col("w0") == 0, F.lit(0).cast("long")).otherwise(F.col("from"))
    past = F.when(F.col("past") == F.col("n_a"), F.col("n")).otherwise(F.col("to"))
    part = F.slice("words", (first + 1).cast("int"), F.greatest(past - first, F.lit(0).cast("long")).cast("int"))
    text = F.array_join(F.when(why.isin("whole", "too short"), F.col("words")).otherwise(part), " ")
    return cut.select(clip, "card", text.alias("fragment"), why.alias("reason"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body over a value that is worked out once, however often the body names it. What the body gives is copied."""
    return F.transform(F.array(value), body)[0]


def _next_of(places: Column, size: Column) -> Column:
    """For each place before `size`, the index of the first of some ascending places at or after it; the array ends after the last of them."""
    before = F.lit(-1).cast("long")
    capped = F.transform(places, lambda p: F.least(F.greatest(p.cast("long"), before), size - 1))
    filled = lambda ps: F.flatten(F.transform(ps, lambda p, k: F.array_repeat(k, (p - F.coalesce(F.get(ps, k - 1), before)).cast("int"))))
    return _once(capped, filled)


def _spaced_within(targets: Column, n: Column) -> Column:
    """reports.spaced of an array: its running maximum is taken over twice as many cuts each time, so that no array is copied a cut."""
    one = F.lit(1).cast("long")

    def run(ts: Column) -> Column:
        doubled = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(ts))
        ahead = F.aggregate(doubled, F.transform(ts, lambda t, i: t - i), lambda so_far, d: F.transform(so_far, lambda t, i: F.greatest(t, F.get(so_far, i - d))))
        return F.transform(ahead, lambda t, i: i + F.least(n - F.size(ts), F.greatest(one, t)))

    return _once(targets, run)


def fragments_within(words: Column, n_a: Column, cards: Column, a: Column, b: Column, verdict: Column, made: Callable[[Column], Column] = lambda text: text, slack: int = 2) -> Column:
    """What fragments() does, for a text that is one row: (card, fragment, reason) of an array of cards (card, w0, w1). Pairs are two arrays, a ascending, without nulls; verdict is an array of cuts, or null.

    A fragment is what is made of its text, its digest for one: where every card has the whole translation, that is made once,
    and a row needn't hold the text once a card.

    Cuts and pairs are looked for by place in the row's own arrays: nothing is sent to another task, and a text takes time in
    proportion to its words, but for the running maximum over its m cuts, which takes m times log m. Pairs are worked out only where they decide.
    """
    zero = F.lit(0).cast("long")

    def told(x: Column, cuts: Column) -> Column:
        """(reason, at): where each cut falls among the words, and how that was found."""
        n, m = x["n"], F.size(cuts)
        way = lambda reason, at: F.struct(F.lit(reason).alias("reason"), at.cast("array<long>").alias("at"))
        share = F.transform(cuts, lambda c: F.rint(c * n / x["n_a"].cast("double")).cast("long"))  # half to even
        first = lambda p, c: F.get(p["of"], c.cast("int"))
        near = lambda p: F.transform(cuts, lambda c: F.when(F.get(p["a"], first(p, c)) - c <= slack, F.get(p["b"], first(p, c)).cast("long")))
        anchors = _once(a, lambda a: _once(F.struct(_next_of(a, x["n_a"]).alias("of"), a.alias("a"), b.alias("b")), near))
        placed = lambda bs: F.when(F.exists(bs, lambda b: b.isNull()), way("proportional", _spaced_within(share, n))).otherwise(way("anchored", _spaced_within(bs, n)))
        ways = F.when(m == 0, way("whole", F.array())).when(_usable(x["verdict"], m, n), way("verdict", x["verdict"])).when(n <= m, way("too short", F.array()))
        return ways.otherwise(_once(anchors, placed))

    def cut(x: Column) -> Column:
        inner = lambda w: F.greatest(zero, F.least(w.cast("long"), x["n_a"] - 1))
        places = F.concat(F.transform(x["cards"], lambda c: inner(c["w0"])), F.transform(x["cards"], lambda c: inner(c["w1"]) + 1))
        cuts = F.sort_array(F.array_distinct(F.filter(places, lambda p: (p > 0) & (p < x["n_a"]))))
        row = lambda c, text, way: F.struct(c["card"].alias("card"), text.alias("fragment"), way["reason"].alias("reason"))

        def parted(cuts: Column, way: Column) -> Column:
            edges = F.struct(_next_of(F.concat(F.array(zero), cuts, F.array(x["n_a"])), x["n_a"] + 1).alias("of"), F.concat(F.array(zero), way["at"], F.array(x["n"])).alias("at"))
            at = lambda e, p: F.get(e["at"], F.get(e["of"], p.cast("int")))
            part = lambda s, e: F.array_join(F.slice(x["words"], (s + 1).cast("int"), F.greatest(e - s, zero).cast("int")), " ")
            return _once(edges, lambda e: F.transform(x["cards"], lambda c: row(c, made(part(at(e, inner(c["w0"])), at(e, inner(c["w1"]) + 1))), way)))

        def rows(cuts: Column, way: Column) -> Column:
            entire = _once(made(F.array_join(x["words"], " ")), lambda text: F.transform(x["cards"], lambda c: row(c, text, way)))
            return F.when(way["reason"].isin("whole", "too short"), entire).otherwise(parted(cuts, way))

        return _once(cuts, lambda cuts: _once(told(x, cuts), lambda way: rows(cuts, way)))

    known = F.filter(cards, lambda c: c["w0"].isNotNull() & c["w1"].isNotNull())
    text = F.coalesce(words, F.array().cast("array<string>"))
    bound = lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n"), n_a.cast("long").alias("n_a"), known.alias("cards"), verdict.alias("verdict"))
    return F.when(n_a > 0, _once(text, lambda w: _once(bound(w), cut)))


def snapped(runs: DataFrame, tokens: DataFrame, spellings: DataFrame, clip: str, reach: int = 12) -> DataFrame:
    """(clip, run, i, j): runs (clip, run, label, i, j) of tokens with their ends pulled onto their label's own first and last words.

    tokens (clip, pos, token, next) have the token after them, spellings (label, side, word) the words accepted for
    side "first" and "last". A token is such a word alone or joined with the one after it. An end goes to
    the nearest one fewer than `reach` tokens ahead, or as many (the last word's) or back; the earlier of two. An end
    without one stays, and both do if the first would come after the last.

    Ends and tokens meet by clip, form and bin of `reach` places, so that a common word of a long clip isn't paired
    with all its places. Null tokens and words match nothing; runs without a label keep their ends.
    """
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    side = lambda name, at, to: F.struct(F.lit(name).alias("side"), at.alias("at"), (at - reach).alias("lo"), to.alias("hi"))
    ends = runs.select(clip, "run", "label", F.inline(F.array(side("first", i, i + reach - 1), side("last", j, j + reach))))
    asked = ends.join(spellings.select("label", "side", F.col("word").alias("form")).distinct(), ["label", "side"])
    binned = asked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach))))
    forms = F.array_distinct(F.array("token", F.concat("token", F.coalesce("next", F.lit("")))))
    spoken = tokens.select(clip, "pos", F.floor(F.col("pos") / reach).alias("bin"), F.explode(forms).alias("form"))
    met = binned.join(spoken, [clip, "bin", "form"]).where(F.col("pos").between(F.col("lo"), F.col("hi")))
    near = met.groupBy(clip, "run", "side").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at")).alias("far"), F.col("pos").cast("long").alias("pos")))["pos"].alias("pos"))
    own = near.groupBy(clip, "run").agg(F.max(F.when(F.col("side") == "first", F.col("pos"))).alias("first"), F.max(F.when(F.col("side") == "last", F.col("pos"))).alias("last"))
    seen = runs.join(own, [clip, "run"], "left")
    lo, hi = F.coalesce("first", i), F.coalesce("last", j)
    return seen.select(clip, "run", F.when(lo <= hi, lo).otherwise(i).alias("i"), F.when(lo <= hi, hi).otherwise(j).alias("j"))


def snapped_within(words: Column, runs: Column, reach: int = 12) -> Column:
    """What snapped() does, for a text that is one row: (run, i, j) of an array of runs (run, i, j, first, last) over an array of words; first and last are arrays of the words accepted there.

    A run looks only at the words around its ends, which stand in its own row: nothing is sent to another task.
    """

    def end(w: Column, at: Column, past: Column, forms: Column) -> Column:
        lo, hi = F.greatest(at - reach, F.lit(0).cast("long")), F.least(past, F.size(w).cast("long") - 1)
        around = F.when(lo <= hi, F.sequence(lo, hi))
        word = lambda k: F.get(w, k.cast("int"))
        fits = lambda k: F.array_contains(forms, word(k)) | F.array_contains(forms, F.concat(word(k), F.coalesce(word(k + 1), F.lit(""))))
        near = F.array_min(F.transform(F.filter(around, fits), lambda k: F.struct(F.abs(k - at).alias("far"), k.alias("pos"))))
        return F.coalesce(near["pos"], at)

    def pulled(w: Column, r: Column) -> Column:
        i, j = r["i"].cast("long"), r["j"].cast("long")
        return F.struct(r["run"].alias("run"), i.alias("i"), j.alias("j"), end(w, i, i + reach - 1, r["first"]).alias("lo"), end(w, j, j + reach, r["last"]).alias("hi"))

    def kept(e: Column) -> Column:
        holds = e["lo"] <= e["hi"]
        return F.struct(e["run"].alias("run"), F.when(holds, e["lo"]).otherwise(e["i"]).alias("i"), F.when(holds, e["hi"]).otherwise(e["j"]).alias("j"))

    return F.transform(F.array(words), lambda w: F.transform(F.transform(runs, lambda r: pulled(w, r)), kept))[0]
