"""Candidates over time: overlaps in bins, the best of them, weighted modes, and a second ranking after a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def meeting(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals (s, e) of left and right (os, oe) that share a key and a point of time at least, each once: as overlapping(), for rules that look at ends and empty intervals themselves."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.greatest(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    pairs = left.withColumn("__bin", bins("s", "e")).join(right.withColumn("__bin", bins("os", "oe")), [*keys, "__bin"])
    first = F.col("__bin") == F.floor(F.greatest("s", "os") / width)
    return pairs.where((F.col("s") <= F.col("oe")) & (F.col("os") <= F.col("e")) & first).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals (s, e) of left and right (os, oe) that share a key and some time, each once, with their overlap.

    Both sides are dealt into bins of `width`, so a hot key is met bin by bin and not paired with itself as
    a whole; a pair counts in the first bin that both touch.
    """
    own = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    other = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("os") / width), F.floor(F.col("oe") / width))))
    overlap = F.least("e", "oe") - F.greatest("s", "os")
    pairs = own.join(other, [*keys, "__bin"]).withColumn("overlap", overlap)
    return pairs.where((F.col("overlap") > 0) & (F.col("__bin") == F.floor(F.greatest("s", "os") / width))).drop("__bin")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(*keys, id, other, overlap): for each interval (id, s, e) the one (other, os, oe) that it shares most time with; ties: the earlier, then the smaller. Null where there is none."""
    pairs = overlapping(left.select(*keys, "id", "s", "e"), right.select(*keys, "other", "os", "oe"), keys, width)
    best = pairs.groupBy(*keys, "id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "os", "other")).alias("best"))
    return left.select(*keys, "id").join(best, [*keys, "id"], "left").select(*keys, "id", F.col("best.other").alias("other"), (-F.col("best.o")).alias("overlap"))


def weighted_mode(ranges: DataFrame, rows: DataFrame, keys: list[str], label: str, weight: str, width: float) -> DataFrame:
    """(*keys, id, label, weight, n, first, last): the label that most weight inside each range (id, s, e) has, ties by label; and its rows (other, os, oe) there, their number, first and last in time.

    One aggregation by label, then one by range: rows are summed before they move.
    """
    inside = overlapping(ranges.select(*keys, "id", "s", "e"), rows.select(*keys, "other", "os", "oe", label, weight), keys, width)
    by_label = inside.groupBy(*keys, "id", label).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min(F.struct("os", "other")).alias("a"), F.max(F.struct("os", "other")).alias("b"))
    best = by_label.groupBy(*keys, "id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("label"), "n", "a", "b")).alias("m"))
    return best.select(*keys, "id", F.col("m.label").alias("label"), (-F.col("m.w")).alias("weight"), F.col("m.n").alias("n"), F.col("m.a.other").alias("first"), F.col("m.b.other").alias("last"))


def rejudged(pool: DataFrame, every: DataFrame, verdicts: DataFrame, clip: str, width: float, penalty: float = 0.8) -> DataFrame:
    """(clip, id, score, state, from_id, rank): a ranked pool (clip, id, label, s, e, score, rank) after a verdict.

    `every` holds all candidates in the pool's columns but the rank, `verdicts` (id, stands, wanted). A candidate
    without a verdict, or that stands, keeps its score. One that doesn't is replaced by the candidate of the
    wanted label that it shares most time with, if there is one and it stands itself ("adjusted"); otherwise
    its score falls ("lowered"). Of candidates that are then alike in label and start the first of the old
    order stays, and the rest are ranked again.
    """
    judged = pool.join(verdicts, "id", "left")
    asks = judged.where(~F.col("stands")).select(clip, F.col("wanted").alias("label"), "id", "s", "e")
    named = every.select(clip, "label", F.col("id").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"))
    found = best_overlap(asks.where("label is not null"), named, [clip, "label"], width).where("other is not null").select("id", "other")
    standing = verdicts.where("stands").select(F.col("id").alias("other"))
    stand_in = every.select(F.col("id").alias("other"), F.col("label").alias("o_label"), F.col("s").alias("o_s"), F.col("score").alias("o_score"))
    confirmed = found.join(standing, "other").join(stand_in, "other")
    seen = judged.join(confirmed, "id", "left")
    adjusted = F.col("other").isNotNull()
    state = F.when(F.col("stands").isNull(), "unjudged").when(F.col("stands"), "stands").when(adjusted, "adjusted").otherwise("lowered")
    score: Column = F.when(adjusted, F.col("o_score")).when(~F.col("stands"), F.round(F.col("score") * penalty, 4)).otherwise(F.col("score"))
    new = seen.select(clip, F.coalesce("other", "id").alias("id"), F.coalesce("o_label", "label").alias("label"), F.coalesce("o_s", "s").alias("s"), score.alias("score"), state.alias("state"), F.when(adjusted, F.col("id")).alias("from_id"), F.col("rank").alias("old"))
    once = new.withColumn("__n", F.row_number().over(Window.partitionBy(clip, "label", "s").orderBy("old"))).where("__n = 1")
    again = Window.partitionBy(clip).orderBy(F.desc("score"), "old")
    return once.select(clip, "id", "score", "state", "from_id", F.row_number().over(again).alias("rank"))
