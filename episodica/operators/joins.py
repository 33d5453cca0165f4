"""Joins with the reference's rules about missing, overlapping and overriding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """A strict lookup: a key that the dimension lacks fails the query when it runs."""
    out = df.join(dim.select(key, value), key, "left")
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit(f"{key} has no {value}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(value)))


def keep_ranges(df: DataFrame, ranges: DataFrame, key: str, position: str) -> DataFrame:
    """Rows whose position lies in some [start, end) of their key. Overlaps don't repeat rows, absent keys are dropped."""
    r = ranges.select(F.col(key).alias("__key"), "start", "end")
    return df.join(r, (F.col(key) == F.col("__key")) & (F.col(position) >= F.col("start")) & (F.col(position) < F.col("end")), "left_semi")


def left_default(df: DataFrame, other: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def override(history: DataFrame, current: DataFrame, keys: list[str], step: str) -> DataFrame:
    """History before the first current step, then the current rows, which win."""
    first = current.groupBy(*keys).agg(F.min(step).alias("__first"))
    old = history.join(first, keys, "left").where(F.col("__first").isNull() | (F.col(step) < F.col("__first"))).drop("__first")
    both = old.withColumn("__rank", F.lit(0)).unionByName(current.withColumn("__rank", F.lit(1)))
    top = F.row_number().over(W.partitionBy(*keys, step).orderBy(F.desc("__rank")))
    return both.withColumn("__top", top).where("__top = 1").drop("__rank", "__top")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full comparison by key: left, right, status (same, differs, left_only, right_only)."""
    both = a.select(*keys, F.col(value).alias("left"), F.lit(1).alias("__l")).join(b.select(*keys, F.col(value).alias("right"), F.lit(1).alias("__r")), keys, "full")
    status = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").when(F.col("left").eqNullSafe(F.col("right")), "same").otherwise("differs")
    return both.withColumn("status", status).drop("__l", "__r")


def fill_missing(wanted: DataFrame, loaded: DataFrame, key: str, value: str, pattern: str) -> DataFrame:
    """Known keys with their loaded value; keys that match the pattern fall back to the wanted one, others are left out."""
    both = wanted.select(key, F.col(value).alias("__want")).join(loaded.select(key, F.col(value).alias("__have"), F.lit(True).alias("__in")), key, "left")
    return both.where(F.col("__in") | F.col(key).rlike(f"^(?:{pattern})$")).select(key, F.coalesce("__have", "__want").alias(value))
