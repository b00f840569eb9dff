"""A cache of what files hold, keyed by their path, size and time of change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import upserted

ENTRY = "path string, size long, changed timestamp, value string"
KEY = ["path", "size", "changed"]


def listed(spark: SparkSession, where: str, pattern: str = "*") -> DataFrame:
    """(path, size, changed) of the files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(where)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def entries(spark: SparkSession, store: str) -> DataFrame:
    """The cache's rows; none where there is no cache yet. Rows that aren't JSON (a value null or cut short) are misses, not errors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(store).where(F.col("value").isNotNull() & F.try_parse_json("value").isNotNull())


def refreshed(spark: SparkSession, where: str, store: str, parse: Callable[[Column], Column], pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(rows, read): (path, value) of all files of a folder as JSON, and (path) of those that had to be read, because they are new, have another size or time of change, or their entry is corrupt.

    parse(content) makes a file's JSON from its bytes. What was read joins the cache at `store`, in a new
    generation of it; entries of files that are gone leave it. Each call is one scan of names and one of the files that changed.
    """
    now, known = listed(spark, where, pattern), entries(spark, store)
    hits = now.join(known.dropDuplicates(KEY), KEY)
    missed = [r.path for r in now.join(known, KEY, "left_anti").select("path").collect()]
    if missed:
        # The paths of changed files alone come to the driver, which lists all files anyway to plan a scan.
        content = spark.read.format("binaryFile").load(missed)
        new = content.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"), parse(F.col("content")).alias("value"))
        upserted(hits.select("path", "size", "changed", "value"), new, ["path"]).write.mode("overwrite").parquet(f"{store}.next")
        _replace(spark, f"{store}.next", store)
    rows = now.join(entries(spark, store), KEY, "left").select("path", "value")
    return rows, spark.createDataFrame([(p,) for p in missed], "path string")


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts one folder in another's place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(old), True)
    system.rename(path(new), path(old))
