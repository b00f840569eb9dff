"""Interval algebra over ordered events of a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(clip: str, *order: str) -> WindowSpec:
    return Window.partitionBy(clip).orderBy(*order)


def gap_filled(start: Column, end: Column, final_end: Column, order: WindowSpec, hold: float = 3.0) -> Column:
    """End of a card that stays until the next one starts, at most `hold` longer than its own end; the starts are never changed."""
    return F.least(F.greatest(F.coalesce(F.lead(start).over(order), final_end), end), end + hold)


def monotone(start: Column, end: Column, order: WindowSpec) -> tuple[Column, Column]:
    """Starts and ends that never go back: both at least the largest time before them."""
    before = F.coalesce(F.max(F.greatest(start, end)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = F.greatest(start, before)
    return first, F.greatest(end, first)


def interpolated(value: Column, order: WindowSpec, step: float) -> Column:
    """Missing values spread evenly between the neighbours that are known; at the ends, `step` a place."""
    at = F.row_number().over(order)
    known = F.when(value.isNotNull(), at)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    v0, k0 = F.last(value, True).over(back), F.last(known, True).over(back)
    v1, k1 = F.first(value, True).over(ahead), F.first(known, True).over(ahead)
    inside = v0 + (v1 - v0) * (at - k0) / (k1 - k0)
    return F.when(value.isNotNull(), value).when(v0.isNull() & v1.isNull(), None).when(v0.isNull(), v1 - step * (k1 - at)).when(v1.isNull(), v0 + step * (at - k0)).otherwise(inside)


def holes_filled(rows: DataFrame, clip: str, order: WindowSpec, most: int = 4) -> DataFrame:
    """(clip, ref, t0, t1, measured): rows (clip, ref, t0, t1) and, where refs jump by 2 to `most` and time advances, one row for each ref in between, evenly spread from the end before to the start after."""
    before, end = F.lag("ref").over(order), F.lag("t1").over(order)
    seen = rows.withColumns({"__hole": F.col("ref") - before, "__ref": before, "__end": end})
    step = (F.col("t0") - F.col("__end")) / F.col("__hole")
    own = F.struct("ref", "t0", "t1", F.lit(True).alias("measured"))

    def guessed(h: Column) -> Column:
        return F.struct((F.col("__ref") + h).alias("ref"), (F.col("__end") + step * (h - 1)).alias("t0"), (F.col("__end") + step * h).alias("t1"), F.lit(False).alias("measured"))

    hole = F.col("__hole").between(2, most) & (F.col("t0") > F.col("__end"))
    filled = F.when(hole, F.concat(F.transform(F.sequence(F.lit(1).cast("long"), F.col("__hole") - 1), guessed), F.array(own))).otherwise(F.array(own))
    return seen.select(clip, F.inline(filled))


def low_runs(rows: DataFrame, clip: str, at: str, level: str, below: float) -> DataFrame:
    """(clip, run, s, e, n, depth): runs of rows more than `below` under the median level of their clip, with their mean level."""
    order = by(clip, at)
    low = rows.join(rows.groupBy(clip).agg(F.median(level).alias("__median")), clip).withColumn("__low", F.col(level) < F.col("__median") - below)
    changed = F.lag("__low").over(order)
    runs = islands(low, clip, changed.isNull() | (F.col("__low") != changed), order).where("__low")
    return runs.groupBy(clip, "run").agg(F.min(at).alias("s"), F.max(at).alias("e"), F.count("*").alias("n"), F.avg(level).alias("depth"))


def coarse_to_fine(rows: DataFrame, clip: str, width: float, below: float, lead: float, tail: float, least: float) -> DataFrame:
    """(clip, coarse_s, coarse_e, fine_s, fine_e): the deepest low run of the means of bins, then the longest low run of the rows (clip, t, level) around it.

    A coarse run counts from a length of `least`, a bin's width included. The rows from `lead` before it to
    `tail` after are judged by their own median; ties go to the earlier run. A clip without a coarse run has no
    row, one without a fine run nulls there.
    """
    bins = rows.groupBy(clip, (F.floor(F.col("t") / width) * width).alias("t")).agg(F.avg("level").alias("level"))
    coarse = low_runs(bins, clip, "t", "level", below).where(F.col("e") - F.col("s") + width >= least)
    best = coarse.groupBy(clip).agg(F.min(F.struct(F.round("depth", 9).alias("depth"), "s", "e")).alias("b")).select(clip, F.col("b.s").alias("coarse_s"), F.col("b.e").alias("coarse_e"))
    near = rows.join(best, clip).where((F.col("t") >= F.col("coarse_s") - lead) & (F.col("t") <= F.col("coarse_e") + tail)).select(clip, "t", "level")
    fine = low_runs(near, clip, "t", "level", below).groupBy(clip).agg(F.min(F.struct((F.col("s") - F.col("e")).alias("d"), "s", "e")).alias("f"))
    return best.join(fine, clip, "left").select(clip, "coarse_s", "coarse_e", F.col("f.s").alias("fine_s"), F.col("f.e").alias("fine_e"))


def clipped(cards: DataFrame, silences: DataFrame, clip: str, least: float) -> DataFrame:
    """Cards (clip, card, s, e) with their end drawn to the first start of a long silence strictly inside them; a silence without an end is ignored. One ordered pass a clip; repeated cards stay."""
    long = silences.where(F.col("e").isNotNull() & (F.col("e") - F.col("s") >= least)).select(clip, F.lit(0).cast("long").alias("mark"), F.col("s").alias("mt"))
    met = next_after(cards.select(clip, "card", "s", "e", F.col("s").alias("t")), long, clip, strict=True)
    return met.select(clip, "card", "s", F.when(F.col("mark_t") < F.col("e"), F.col("mark_t")).otherwise(F.col("e")).alias("e"))


def subtracted(start: Column, end: Column, windows: Column, least: float = 0.2) -> Column:
    """(s, e) of an interval after an ordered list of windows (a, b) has been taken from it, each from what the ones before left: covered, null; head or tail overlapped, trimmed; spanned, the leading part. Null if shorter than `least`."""
    state = F.struct(start.alias("s"), end.alias("e"), F.lit(False).alias("gone"))

    def take(x: Column, w: Column) -> Column:
        s, e = x["s"], x["e"]
        cover = (s >= w["a"]) & (e <= w["b"])
        head = (w["a"] <= s) & (s < w["b"])
        tail = (w["a"] < e) & (e <= w["b"])
        span = (s < w["a"]) & (e > w["b"])
        left = F.struct(F.when(head, w["b"]).otherwise(s).alias("s"), F.when(~head & (tail | span), w["a"]).otherwise(e).alias("e"), (x["gone"] | cover).alias("gone"))
        return F.when(x["gone"], x).otherwise(left)

    return F.aggregate(windows, state, take, lambda x: F.when(~x["gone"] & (x["e"] - x["s"] >= least), F.struct(x["s"].alias("s"), x["e"].alias("e"))))


def remapped(times: DataFrame, cuts: DataFrame, clip: str) -> DataFrame:
    """Times (clip, id, t) less the length of all cuts (clip, s, e) that end by then: a running sum over both in order, ends before times that are equal. Cuts without numbers count nothing; a null time stays null."""
    ended = cuts.where(F.col("e").isNotNull()).select(clip, F.col("e").alias("t"), F.lit(0).alias("kind"), F.coalesce(F.col("e") - F.col("s"), F.lit(0.0)).alias("length"))
    both = times.select(clip, "id", "t", F.lit(1).alias("kind")).unionByName(ended, allowMissingColumns=True)
    removed = F.sum(F.coalesce("length", F.lit(0.0))).over(by(clip, "t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("removed", removed).where("kind = 1").select(clip, "id", "t", (F.col("t") - F.col("removed")).alias("t_new"))


def complement(cuts: DataFrame, clip: str, end: str) -> DataFrame:
    """What cuts (clip, s, e, end) leave of [0, end]: the intervals between the furthest end so far and the next start."""
    order = by(clip, "s", "e")
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = cuts.select(clip, reach.alias("s"), F.col("s").alias("e"))
    tail = cuts.groupBy(clip).agg(F.max("e").alias("s"), F.max(end).alias("e"))
    return gaps.unionByName(tail).where("e > s")


def sequential_schedule(cards: DataFrame, clip: str, fps: int, fade: float, least: float, duration: float) -> DataFrame:
    """Cards (clip, i, s, e) with fades (t_in, d_in, t_out, d_out) that never overlap, and hard_cut.

    A changeover belongs to a card and the next one and knows their gap alone: both fades have the length that
    the gap leaves for each, but `least`; the one in begins on a frame, and the one out ends half a frame
    earlier, longer where the gap has room. A card whose fade out would begin before its own fade in is
    over keeps what is left; the next one then comes as a hard cut. So a row needs its neighbours only.
    """
    order = by(clip, "i")
    framed = lambda t: F.bround(t * fps) / fps
    guard = 0.5 / fps
    room = F.lead("s").over(order) - F.col("e") - guard
    size = F.when(room >= 2 * fade, F.lit(fade)).otherwise(F.greatest(F.lit(least), F.greatest(room, F.lit(0.0)) / 2))
    over = cards.withColumn("size", F.when(F.lead("s").over(order).isNotNull(), size)).withColumn("next_in", framed(F.lead("s").over(order) - F.col("size")))
    came = over.withColumns({"t_in": F.coalesce(F.lag("next_in").over(order), F.greatest(F.col("s") - 0.05, F.lit(0.0))), "d_in": F.coalesce(F.lag("size").over(order), F.lit(fade)), "gone": F.col("next_in") - guard})
    wished = F.greatest(F.col("size"), F.least(F.lit(fade), F.col("gone") - framed(F.col("e"))))
    left = F.col("gone") - F.col("t_in") - F.col("d_in")
    fitted = came.withColumns({"wished": wished, "left": left}).withColumn("cut", F.col("wished") > F.col("left"))
    d_out = F.when(F.col("size").isNull(), F.lit(fade)).when(F.col("cut"), F.greatest(F.lit(1.0 / fps), F.col("left"))).otherwise(F.col("wished"))
    ends = fitted.withColumn("d_out", d_out).withColumn("t_out", F.coalesce(F.col("gone") - F.col("d_out"), F.least(F.lit(duration - fade), F.col("e") - 0.15)))
    return ends.withColumn("hard_cut", F.coalesce(F.lag("cut").over(order), F.lit(False))).select(clip, "i", "s", "e", "t_in", "t_out", "d_in", "d_out", "hard_cut")


def drawn_back(words: DataFrame, repeats: DataFrame, clip: str, least: float = 0.5) -> DataFrame:
    """Words (clip, i, s, e) after repeats (clip, first, second): the first word at or after a repeat's second start begins at its first start, if that moves it by `least` and not to or before the word ahead of it, whose end gives way. Of several repeats of a word the earliest start counts."""
    points = repeats.select(clip, "first", F.col("second").alias("t"))
    named = next_after(points, words.select(clip, F.col("i").cast("long").alias("mark"), F.col("s").alias("mt")), clip).where("mark is not null")
    wanted = named.groupBy(clip, F.col("mark").alias("i")).agg(F.min("first").alias("first"))
    order = by(clip, "i")
    moved = words.join(wanted, [clip, "i"], "left").withColumn("moves", (F.col("s") - F.col("first") >= least) & (F.col("first") > F.coalesce(F.lag("s").over(order), F.lit(float("-inf")))))
    start = F.when(F.col("moves"), F.col("first")).otherwise(F.col("s"))
    end = F.least(F.col("e"), F.when(F.lead("moves").over(order), F.lead("first").over(order)))
    return moved.select(clip, "i", start.alias("s"), end.alias("e"))


def islands(rows: DataFrame, clip: str, breaks: Column, order: WindowSpec, name: str = "run") -> DataFrame:
    """Numbers the runs of a clip: a new one starts wherever `breaks` holds."""
    return rows.withColumn("__b", F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).withColumn(name, F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def nearest(points: DataFrame, marks: DataFrame, clip: str, radius: float) -> DataFrame:
    """For each point (clip, id, t) the mark (clip, mark, mt, depth) within the radius that is deepest, then nearest, then smallest.

    Points meet the marks of their own bin of a radius and of the two beside it, so a long clip isn't paired with itself.
    """
    own = points.withColumn("bin", F.floor(F.col("t") / radius))
    around = F.floor(F.col("mt") / radius)
    named = marks.withColumn("bin", F.explode(F.array(around - 1, around, around + 1)))
    near = own.join(named, [clip, "bin"]).where((F.col("mt") >= F.col("t") - radius) & (F.col("mt") <= F.col("t") + radius))
    best = F.min(F.struct((-F.col("depth")).alias("d"), F.abs(F.col("mt") - F.col("t")).alias("gap"), F.col("mark").alias("mark"))).alias("best")
    return near.groupBy(clip, "id").agg(best).select(clip, "id", F.col("best.mark").alias("mark"), F.col("best.gap").alias("gap"))


def next_after(points: DataFrame, marks: DataFrame, clip: str, strict: bool = False) -> DataFrame:
    """Points (clip, t, ...) without t, with the first mark (clip, mark, mt) at or after it, or strictly after it, as mark and mark_t: both tables in one ordered pass, without a range join."""
    others = [c for c in points.columns if c not in (clip, "t")]
    both = points.withColumnRenamed("t", "at").withColumn("kind", F.lit(1)).unionByName(marks.select(clip, F.col("mt").alias("at"), F.lit(0).alias("kind"), "mark"), allowMissingColumns=True)
    # Backwards in time: marks of a point's own time have been passed where they count, and are yet to come where they don't.
    order = Window.partitionBy(clip).orderBy(F.desc("at"), F.desc("kind") if strict else F.asc("kind"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("kind") == 0, F.struct("mark", "at")), True).over(order)
    return both.withColumn("next", seen).where("kind = 1").select(clip, *others, F.col("next.mark").alias("mark"), F.col("next.at").alias("mark_t"))
