"""Sessions of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of Parquet files as they arrive, with a time that takes a watermark."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions (user_id, s, last, n, total) that a gap ends. Events later than `late` are left out, and the last sessions stay open until time moves on."""
    window = F.session_window("at", gap)
    found = events.withWatermark("at", late).groupBy("user_id", window.alias("w")).agg(F.min("at").alias("s"), F.max("at").alias("last"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.drop("w")
