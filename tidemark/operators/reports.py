"""Findings and counts over a clip's rows, cuts that follow anchors, medians with a quorum, and markers of three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import by, islands, next_after


def spaced(target: Column, clip: str) -> Column:
    """Cuts i of a clip's n words as near their targets as ascending by one at least, and leaving a word for each cut after them and one at the end, allows: their number and a running maximum. Null with too few words."""
    m = F.count("*").over(Window.partitionBy(clip))
    ahead = F.max(target - F.col("i")).over(by(clip, "i").rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("n") > m, F.col("i") + F.least(F.col("n") - m, F.greatest(F.lit(1).cast("long"), ahead)))


def anchored_cuts(cuts: DataFrame, pairs: DataFrame, words: DataFrame, clip: str, slack: int = 2) -> DataFrame:
    """(clip, i, cut, anchor): cuts (clip, i, cut) of one text carried over to another whose words pair with it (clip, a, b; both ascending); words (clip, n) is that text's number of words.

    A cut goes to the first pair at or after it, at most `slack` words further; cuts ascend by one at
    least, and leave a word for each cut after them and one at the end (`spaced`), so no fold is needed. A clip with a cut that no pair carries, or with too few words, has nulls only.
    """
    points = cuts.select(clip, F.col("i").cast("long").alias("id"), F.col("cut").cast("double").alias("t"))
    marks = pairs.select(clip, F.col("b").cast("long").alias("mark"), F.col("a").cast("double").alias("mt"))
    met = next_after(points, marks, clip).withColumnRenamed("id", "i").join(cuts.select(clip, F.col("i").cast("long").alias("i"), "cut"), [clip, "i"]).join(words, clip)
    whole = Window.partitionBy(clip)
    lost = F.col("mark").isNull() | (F.col("mark_t") - F.col("cut") > slack)
    carried = F.max(lost).over(whole) == F.lit(False)
    return met.select(clip, "i", "cut", F.when(carried, spaced(F.col("mark"), clip)).alias("anchor"))


def coverage_report(words: DataFrame, clip: str, unsure: float = 0.5, stretch: int = 4) -> DataFrame:
    """(clip, n_words, coverage, segments, mean_conf, unsure, labels, backward, span, stretches) of words (clip, t, id, label, place, conf) in order; a null label wasn't placed.

    A segment is a run of placed words of one label, those not placed left out. backward counts segments whose
    place is before the one ahead of them; stretches are runs of `stretch` words or more that weren't placed.
    """
    order = by(clip, "t", "id")
    placed = F.col("label").isNotNull()
    runs = islands(words.withColumn("placed", placed), clip, F.lag("placed").over(order).isNull() | (F.lag("placed").over(order) != F.col("placed")), order)
    gaps = runs.where(~F.col("placed")).groupBy(clip, "run").count().where(F.col("count") >= stretch).groupBy(clip).agg(F.count("*").alias("stretches"))
    own = words.where(placed)
    segments = islands(own, clip, F.lag("label").over(order).isNull() | (F.lag("label").over(order) != F.col("label")), order).groupBy(clip, "run").agg(F.avg("conf").alias("conf"), F.min("place").alias("place"), F.min("t").alias("s"), F.max("t").alias("e"), F.first("label").alias("label"))
    back = F.col("place") < F.lag("place").over(by(clip, "run"))
    told = segments.withColumn("back", back).groupBy(clip).agg(F.count("*").alias("segments"), F.avg("conf").alias("mean_conf"), F.count_if(F.col("conf") < unsure).alias("unsure"), F.countDistinct("label").alias("labels"), F.count_if("back").alias("backward"), (F.max("e") - F.min("s")).alias("span"))
    counted = words.groupBy(clip).agg(F.count("*").alias("n_words"), F.avg(placed.cast("int")).alias("coverage"))
    zero = {c: 0 for c in ("segments", "unsure", "labels", "backward", "stretches")}
    return counted.join(told, clip, "left").join(gaps, clip, "left").fillna(zero)


def cut_findings(cuts: DataFrame, phrases: DataFrame, clip: str, width: float) -> DataFrame:
    """(clip, rule, cut, other) of cuts (clip, cut, s, e, length) that end before they begin ("order"), leave [0, length] ("bounds"), begin before the one ahead of them ends ("overlap"), or share time with a phrase (clip, phrase, ps, pe) ("phrase").

    Cuts and phrases meet in bins of `width`. A cut without numbers has no finding.
    """
    known = cuts.where(F.col("s").isNotNull() & F.col("e").isNotNull())
    nothing = F.lit(None).cast("long")
    order = known.where(F.col("s") >= F.col("e")).select(clip, F.lit("order").alias("rule"), "cut", nothing.alias("other"))
    bounds = known.where((F.col("s") < 0) | (F.col("e") > F.col("length") + 1e-6)).select(clip, F.lit("bounds").alias("rule"), "cut", nothing.alias("other"))
    ahead = F.lead(F.struct("cut", "s")).over(by(clip, "s", "e", "cut"))
    overlap = known.withColumn("next", ahead).where(F.col("next.s") < F.col("e")).select(clip, F.lit("overlap").alias("rule"), "cut", F.col("next.cut").cast("long").alias("other"))
    reach = lambda a, b: F.sequence(F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width))
    c = known.withColumn("__bin", F.explode(reach("s", "e")))
    p = phrases.where(F.col("ps").isNotNull() & F.col("pe").isNotNull()).withColumn("__bin", F.explode(reach("ps", "pe")))
    first = F.greatest(F.floor(F.least("s", "e") / width), F.floor(F.least("ps", "pe") / width))
    inside = c.join(p, [clip, "__bin"]).where((F.col("s") < F.col("pe")) & (F.col("ps") < F.col("e")) & (F.col("__bin") == first))
    phrase = inside.select(clip, F.lit("phrase").alias("rule"), "cut", F.col("phrase").cast("long").alias("other"))
    return order.unionByName(bounds).unionByName(overlap).unionByName(phrase)


def quorum_medians(frames: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, hits, *values): the upper middle of each value over the frames of a key that have it, null where fewer than half of its frames do.

    Values are counted first, so the rows of a hot key are combined before they are put in order.
    """
    seen = F.col(values[0]).isNotNull()
    out = frames.groupBy(key).agg(F.count("*").alias("frames"), F.count_if(seen).alias("hits"))
    for v in values:
        order = Window.partitionBy(key).orderBy(v)
        counts = frames.where(seen & F.col(v).isNotNull()).groupBy(key, v).agg(F.count("*").alias("__n"))
        placed = counts.withColumn("__to", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(key)))
        middle = F.floor(F.col("__all") / 2)
        out = out.join(placed.where((F.col("__to") > middle) & (F.col("__to") - F.col("__n") <= middle)).select(key, F.col(v).alias(v)), key, "left")
    quorum = F.col("hits") * 2 >= F.col("frames")
    return out.select(key, "hits", *(F.when(quorum, F.col(v)).alias(v) for v in values))


def marker(tags: Column, yes: list[str], no: list[str]) -> Column:
    """What an array of tags says: true, false, or null where it is missing or has neither. Yes wins."""
    has = lambda words: F.arrays_overlap(tags, F.array(*map(F.lit, words)))
    return F.when(has(yes), True).when(has(no), False)


def marked(record: Column, record_at: Column, seen: Column) -> Column:
    """(value, at, action) of a record of three values with its date, after a marker was seen.

    Nothing seen, or the same: kept. A marker that is set where the record isn't is taken, with the date that
    the record has or "unknown", never one made up. A record that is set is never unset: a conflict.
    """
    takes = seen & ~F.coalesce(record, F.lit(False))
    lowers = ~seen & record.isNull()
    value = F.when(takes, True).when(lowers, False).otherwise(record)
    given = F.when(F.trim(record_at) != "", record_at)
    at = F.when(takes, F.coalesce(given, F.lit("unknown"))).when(lowers, F.lit("")).otherwise(F.coalesce(record_at, F.lit("")))
    action = F.when(seen.isNull(), "unseen").when(takes, "promote").when(lowers, "settle").when(record & ~seen, "conflict").otherwise("ok")
    return F.struct(value.alias("value"), at.alias("at"), action.alias("action"))
