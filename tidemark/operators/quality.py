"""Data-quality rules: each yields findings (entity, rule, severity, message), which are united. And order statistics of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def findings(rows: DataFrame, entity: Column, rule: str, severity: str, broken: Column, message: Column | str) -> DataFrame:
    """A finding for each row that breaks a rule; a test that is null breaks nothing."""
    said = F.lit(message) if isinstance(message, str) else message
    return rows.where(broken).select(entity.cast("string").alias("entity"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), said.alias("message"))


def findings_of_rows(rows: DataFrame, entity: Column, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """The findings of several rules (rule, severity, broken, message) in one pass over the rows, which are then worked out once."""
    told = [F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for rule, severity, broken, message in rules]
    return rows.select(entity.cast("string").alias("entity"), F.inline(F.filter(F.array(*told), lambda x: x.isNotNull())))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unknown_keys(rows: DataFrame, entity: str, keys: Column, known: list[str]) -> DataFrame:
    """(entity, key) of the keys of each row that a closed schema doesn't have."""
    odd = F.array_except(keys, F.array(*map(F.lit, known)))
    return rows.select(entity, F.explode(odd).alias("key"))


def reconciled(marker: Column, record: Column) -> Column:
    """What to do where a three-valued marker meets a record: equal is ok, a true marker promotes, a missing one says nothing, and a false one against a true record is a conflict; nothing is ever demoted."""
    return F.when(marker.isNull(), "unknown").when(marker == record, "ok").when(marker, "promote").otherwise("conflict")


def value_counts(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, what, value, n, upto, total): how often each group has each value of each named column, the running count in order of value, and the count of all.

    One pass, counted before the shuffle, so that a hot group sends its different values and not its rows; these
    stream through the running count in order. Nulls are left out.
    """
    stacked = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(k).alias("what"), v.cast("double").alias("value")) for k, v in values.items()))))
    counted = stacked.where("value is not null").groupBy(*by, "what", "value").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*by, "what")
    return counted.withColumn("upto", F.sum("n").over(of.orderBy("value"))).withColumn("total", F.sum("n").over(of))


def quantile(what: str, share: float) -> Column:
    """Of value_counts(), as an aggregate: the quantile of a column, interpolated between neighbours."""
    place = F.lit(share) * (F.col("total") - 1)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("what") == what) & (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")), F.col("value")))

    part = F.max(F.when(F.col("what") == what, place - F.floor(place)))
    return at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part
