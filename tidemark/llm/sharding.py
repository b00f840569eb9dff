"""Operator 4, sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

SHARDS = 40


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score for a key, where a shard's score is -weight / ln(u) and u a hash of key and shard in (0, 1).

    Scores of a shard depend on the key and that shard alone, so a further shard takes rows only into
    itself and a larger weight takes a proportional share. Equal scores: the larger shard number.
    """
    shards = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)))

    def scored(s: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, s["id"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-s["weight"] / F.ln(u)).alias("score"), s["id"].alias("id"))

    return F.array_max(F.transform(shards, scored))["id"]


def shard(docs: DataFrame, weights: list[float], grown: list[float], buckets: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text plus 16 (null text: 16 and the crc of nothing, 0). The key is hashed as
    text, a null key as an empty one. Rows that share a key share a shard and have slots of their own.
    Slots are gapless in a shard: a shard is dealt into `buckets` (by default the number of shuffle
    partitions), counted, given offsets by a running sum over the counts, and numbered bucket by bucket,
    so no task ever holds a whole shard. Rows of one key that overfill a bucket are dealt further by
    their text's crc and size. An empty table gives no row; further columns are ignored.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        rendezvous(name, grown).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    return numbered.join(first, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
