"""Writers. Nothing is overwritten; a table appears as a whole or not at all, by the committer of the write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    found = [p for p in paths if exists(spark, p)]
    if found:
        raise FileExistsError(f"outputs exist: {found}")


def metric_events(df: DataFrame, step: str, metrics: str) -> DataFrame:
    """One JSON line a row, as the metric readers take it. A step below 0 or a value that isn't finite fails the write."""
    fine = (F.col(step) >= 0) & F.forall(F.map_values(metrics), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col(step).alias("step"), F.col(metrics).alias("metrics")))
    return df.select(F.when(F.coalesce(fine, F.lit(False)), body).otherwise(F.raise_error(F.lit("metrics must be finite numbers with a step from 0 on"))).alias("value"))


def append_metrics(df: DataFrame, step: str, metrics: str, path: str) -> None:
    metric_events(df, step, metrics).write.mode("append").text(path)


def wide_metrics(df: DataFrame, key: str, metrics: str) -> DataFrame:
    """One column a metric, sorted by name. The names are the distinct keys of a log, not its rows."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(metrics))).distinct().collect())
    return df.select(key, *[F.try_element_at(F.col(metrics), F.lit(n)).alias(n) for n in names])


def write_once(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at a new path; if the path holds a table already, it must hold the same rows."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return spark.read.parquet(path)
    there = spark.read.parquet(path)
    if there.columns != df.columns or not there.exceptAll(df).isEmpty() or not df.exceptAll(there).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return there


def rewritten(df: DataFrame, path: str, columns: dict, keep=None) -> DataFrame:
    """A new version of a table with recomputed columns and, if wanted, fewer rows. The old version stays."""
    df = df if keep is None else df.where(keep)
    refuse_existing(df.sparkSession, path)
    df.withColumns(columns).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stats_json(stats: DataFrame) -> DataFrame:
    """(key, mean, std, q01, q99: arrays) -> (key, json)."""
    return stats.select("key", F.to_json(F.struct("mean", "std", "q01", "q99")).alias("json"))


def stats_from_json(df: DataFrame) -> DataFrame:
    return df.select("key", F.from_json("json", "mean array<double>, std array<double>, q01 array<double>, q99 array<double>").alias("s")).select("key", "s.*")
