"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least(links: DataFrame, name: str) -> DataFrame:
    """(u, m): the smallest of u and its neighbours. Written, so that the join after it can split a hot u."""
    return written(links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), name)


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u > v), as such links again."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both, "large"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    large = written(large.distinct(), "links")
    least = _least(large, "small")
    moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v")).where(F.col("u") != F.col("v"))).distinct(), "links")
    drop_written(large, least)
    return out


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link (u, v), the component being its smallest node.

    Every step is a few shuffles of the links, whose number doesn't grow; the steps end when one changes
    nothing, after a number of rounds that grows with the logarithm of the longest chain. Null ends and
    links of a node to itself are ignored.
    """
    now = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        old, now = now, _stars(now)
        drop_written(old)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
