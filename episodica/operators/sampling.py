"""Seeded order, batches, ranks, mixtures. Deterministic for a seed; not the same draws as any other library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / float(1 << 52)


def shuffle(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed + epoch), F.col(key)), F.col(key))


def _placed(df: DataFrame, order: list) -> tuple[DataFrame, Column]:
    """Rows dealt out by ranges of the order and written once, so every reading finds them at the same place; and their range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return written(placed, "placed"), F.shiftright("__id", 33).cast("int")


def _before(sums: dict[int, float], kind: str, part: Column) -> Column:
    """For each range the sum of those before it: one number a range, whatever the input."""
    shift, total = [], 0
    for k in range(max(sums, default=-1) + 1):
        shift.append(total)
        total += sums.get(k) or 0
    return F.get(F.array(*[F.lit(x).cast(kind) for x in shift or [0]]), part)


def indexed(df: DataFrame, order: list, out: str = "at") -> DataFrame:
    """Rows with their place in a total order, from 0, without dealing all rows to one task."""
    placed, part = _placed(df, order)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}
    return placed.withColumn(out, _before(counts, "long", part) + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def running(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """out: the sum of value over all rows before, in a total order. Ranges are summed first, then rows within a range."""
    placed, part = _placed(df, order)
    kind = "double" if dict(df.dtypes)[value] in ("double", "float") else "long"
    sums = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).agg(F.sum(value)).collect()}
    inside = F.sum(value).over(W.partitionBy(part).orderBy("__id").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn(out, _before(sums, kind, part) + F.coalesce(inside, F.lit(0))).drop("__id")


def batches(df: DataFrame, key: str, size: int, seed: int, start: int = 0) -> DataFrame:
    """Batch numbers in the seeded order from batch `start` on; the last incomplete batch is dropped."""
    full = df.count() // size
    placed = indexed(df, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "__at").withColumn("batch", F.floor(F.col("__at") / size))
    return placed.where((F.col("batch") >= start) & (F.col("batch") < full)).drop("__at")


def rank_rows(df: DataFrame, order: str, ranks: int, rank: int) -> DataFrame:
    """Every ranks-th row: ranks never share one."""
    return indexed(df, [F.col(order)], "__at").where(F.col("__at") % ranks == rank).drop("__at")


def mixture(sources: dict[str, DataFrame], weights: dict[str, float], n: int, seed: int, key: str) -> DataFrame:
    """n draws (draw, source, and the drawn row): the source by weight, the row by a hash; sources repeat as often as need be.

    Sources have the same columns; key orders their rows. Weights must sum to 1 exactly.
    """
    if sum(weights.values()) != 1.0:
        raise ValueError("weights must sum to 1")
    spark = next(iter(sources.values())).sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("__u", uniform(seed, F.col("draw")))
    out, low = None, 0.0
    for name, w in weights.items():
        rows = indexed(sources[name], [F.col(key)], "__row")
        size = rows.count()
        high = low + w if name != list(weights)[-1] else 2.0
        mine = draws.where((F.col("__u") >= low) & (F.col("__u") < high)).select("draw", F.lit(name).alias("source"), F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.lit(max(1, size))).alias("__row"))
        part = mine.join(rows, "__row").drop("__row")
        out, low = part if out is None else out.unionByName(part), low + w
    return out


def choose(columns: list[str], key: str, seed: int) -> Column:
    """One of the columns, by the key."""
    return F.element_at(F.array(*[F.col(c) for c in columns]), (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(len(columns))) + 1).cast("int"))
