"""Names resolved to clips and files, sizes audited, and a block anchor by median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolved(asked: DataFrame, clips: DataFrame, files: DataFrame) -> DataFrame:
    """(id, clip, file) of names asked for (id, arg), against clips (clip, derived) and files (file).

    A clip's own name wins, with its derived file if that is there. Otherwise a file is meant whose name is equal but
    for case, the ending .mp4 put on where it is missing; the first such file by name, and the first clip that it
    is derived from, if any. Nothing found: nulls. Repeated clips and files count once; a null name finds nothing.
    """
    by_file = clips.groupBy(F.col("derived").alias("file")).agg(F.min("clip").alias("owner"))
    there = files.select("file").distinct()
    own = clips.groupBy(F.col("clip").alias("arg")).agg(F.min("derived").alias("derived")).join(there.withColumnRenamed("file", "derived").withColumn("found", F.col("derived")), "derived", "left").select("arg", F.lit(True).alias("named"), "found")
    folded = there.groupBy(F.lower("file").alias("want")).agg(F.min("file").alias("file")).join(by_file, "file", "left")
    low = F.lower("arg")
    want = F.when(low.endswith(".mp4"), low).otherwise(F.concat(low, F.lit(".mp4")))
    both = asked.withColumn("want", want).join(own, "arg", "left").join(folded, "want", "left")
    named = F.col("named").isNotNull()
    return both.select("id", F.when(named, F.col("arg")).otherwise(F.col("owner")).alias("clip"), F.when(named, F.col("found")).otherwise(F.col("file")).alias("file"))


def unlisted(settings: DataFrame, listed: DataFrame) -> DataFrame:
    """Settings (style, path, ...) whose last key says pixels or points and that the list (path) of scaled ones lacks."""
    return settings.where(F.col("path").rlike("(_px|_pt)$")).join(listed.select("path").distinct(), "path", "left_anti")


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, median, n): the upper middle value of each group, by counts of its different values. Nulls are left out."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    so_far = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", so_far).join(counted.groupBy(*keys).agg(F.sum("c").alias("n")), keys)
    return ranked.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))).select(*keys, F.col(value).alias("median"), "n")


def centred_blocks(blocks: DataFrame, clip: str, height: int, target: float, trial: float = 0.5) -> DataFrame:
    """(clip, anchor, lowest, highest): the anchor, a share of the frame's height to three decimals, that moves each clip's median block (top, bottom; measured at the trial anchor) to the target, and where its first and last block's middles then are."""
    middles = blocks.withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
    anchor: Column = F.bround(F.lit(target) - (F.col("median") / height - F.lit(trial)), 3)
    solved = upper_median(middles, [clip], "mid").select(clip, anchor.alias("anchor"))
    ends = middles.groupBy(clip).agg(F.min("mid").alias("a"), F.max("mid").alias("b"))
    moved = lambda c: F.round(F.col(c) / height - F.lit(trial) + F.col("anchor"), 4)
    return solved.join(ends, clip).select(clip, "anchor", moved("a").alias("lowest"), moved("b").alias("highest"))


def hop_levels(samples: DataFrame, clip: str, at: str, value: str, hop: float) -> DataFrame:
    """(clip, t, db): level of each fixed hop of time that has samples, in decibels, floored at a millionth."""
    binned = samples.groupBy(clip, F.floor(F.col(at) / hop).alias("bin")).agg(F.avg(F.col(value) * F.col(value)).alias("power"))
    return binned.select(clip, (F.col("bin") * hop).alias("t"), (20 * F.log10(F.greatest(F.lit(1e-6), F.sqrt("power")))).alias("db"))
