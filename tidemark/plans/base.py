"""Registration of queries, and the views of the tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) under a name, with its DuckDB equivalent where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 2024-01-01 in microseconds: events are timed from there.
EPOCH = 1_704_067_200_000_000
EVENTS_SQL = f"e AS (SELECT user_id, event_id, event_type, value, (epoch_us(ts) - {EPOCH}) / 1e6 AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, value, t): a user is a clip, t its time in seconds."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", ((ts - F.lit(EPOCH)) / F.lit(1e6)).alias("t"))
