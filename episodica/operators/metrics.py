"""Metric logs: rollback, smoothing, intervals, throughput, the wide report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rollback(df: DataFrame, run: str, arrival: list[str], step: str, values: list[str]) -> DataFrame:
    """What stays of a log in which a smaller or equal step discards all that it goes back over.

    Rows of one step in direct succession are one entry, for each value the last one that isn't null. An entry stays
    if all later entries have greater steps. Gaps and islands, then a minimum over what follows: one shuffle by run.
    """
    by = W.partitionBy(run).orderBy(*arrival)
    islands = df.withColumn("__new", (F.lag(step).over(by).isNull() | (F.lag(step).over(by) != F.col(step))).cast("int"))
    islands = islands.withColumn("__island", F.sum("__new").over(by)).withColumn("__nth", F.row_number().over(by))
    last = [F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col("__nth"))).alias(v) for v in values]
    entries = islands.groupBy(run, "__island", step).agg(*last)
    later = F.min(step).over(W.partitionBy(run).orderBy("__island").rowsBetween(1, W.unboundedFollowing))
    return entries.withColumn("__later", later).where(F.col("__later").isNull() | (F.col("__later") > F.col(step))).drop("__later", "__island")


def moving_average(df: DataFrame, key: str, order: str, value: str, out: str = "smooth") -> DataFrame:
    """Trailing mean over max(3, min(25, n / 20)) rows; unchanged with fewer than 8 rows."""
    n = F.count("*").over(W.partitionBy(key))
    width = F.greatest(F.lit(3), F.least(F.lit(25), F.floor(n / 20)))
    by = W.partitionBy(key).orderBy(order)
    recent = F.reverse(F.collect_list(value).over(by.rowsBetween(-24, 0)))
    df = df.withColumn("__w", F.when(n >= 8, width).otherwise(1)).withColumn("__recent", recent)
    part = F.slice("__recent", F.lit(1), F.col("__w").cast("int"))
    return df.withColumn(out, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)).drop("__w", "__recent")


def interval_mean(df: DataFrame, keys: list[str], step: str, every: int, values: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(step) / every).alias("interval")).agg(*[F.avg(v).alias(v) for v in values])


def throughput(given: str, seconds: str, batch: int | None) -> Column:
    """The given figure, or batch / seconds if the batch is known."""
    return F.col(given) if batch is None else F.coalesce(F.col(given), F.lit(batch) / F.col(seconds))


def wide(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One column a metric, sorted by name. The names come from one distinct pass."""
    names = sorted(r[0] for r in df.select(name).distinct().collect())
    return df.groupBy(key).pivot(name, names).agg(F.max(value))
