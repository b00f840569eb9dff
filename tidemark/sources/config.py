"""Closed configurations, caches and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def closed(rows: DataFrame, raw: str, schema: T.StructType, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, findings) of a column of JSON mappings: keys that the schema lacks are findings (entity, key) and their rows are left out; missing keys take defaults."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    odd = F.array_except(keys, F.array(*map(F.lit, schema.fieldNames())))
    told = rows.withColumn("__odd", odd)
    typed = F.from_json(raw, schema)
    values = [F.coalesce(typed[f.name], F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else typed[f.name].alias(f.name) for f in schema.fields]
    others = [c for c in rows.columns if c != raw]
    return told.where(F.size("__odd") == 0).select(*others, *values), told.select(*others, F.explode("__odd").alias("key"))


def overlaid(defaults: dict[str, str], overrides: Column) -> Column:
    """A map of defaults in which a map's entries win."""
    base = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in defaults.items())))
    mine = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(mine, k)), mine)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, of equal keys those of new."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__at", "__r")


def write_partition(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_partition(spark: SparkSession, path: str, by: str, value: str) -> DataFrame:
    """One partition, never another in its place."""
    return spark.read.parquet(path).where(F.col(by) == value)


def cache_key(*parts: Column) -> Column:
    """The start of a digest of parts; a changed part is another key."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)


def stale(old: Column, new: Column, tolerance: float = 0.01) -> Column:
    """Why a result for the window `old` [a, b] can't serve `new`: null if it can. A missing end is open; a missing stamp is told apart."""
    far = lambda k: ~(F.get(old, F.lit(k)).eqNullSafe(F.get(new, F.lit(k))) | F.coalesce(F.abs(F.get(old, F.lit(k)) - F.get(new, F.lit(k))) <= tolerance, F.lit(False)))
    return F.when(old.isNull(), "no stamp").when(far(0), "start moved").when(far(1), "end moved")
