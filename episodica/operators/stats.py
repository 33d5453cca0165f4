"""Statistics by dimension, quantiles, extrema and group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def moments(x, prefix: str = "") -> list[Column]:
    """Mean and population deviation from sums, a negative variance counting as 0."""
    x = F.col(x) if isinstance(x, str) else x
    return [F.avg(x).alias(f"{prefix}mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x))).alias(f"{prefix}std")]


def explode_dims(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.col(array).cast("array<double>")).alias("dim", "x"))


def histogram_quantiles(df: DataFrame, key: str, x: str, quantiles: dict[str, float], bins: int = 5000, widen: float = 1e-10, also: list[Column] = ()) -> DataFrame:
    """For each key the left edge of the first of `bins` bins at which the running count reaches q * n.

    Two passes: ranges first (one row a key, written once), then counts by bin. The last bin is closed. also: further
    aggregates that the first pass takes along. Ranges are joined from the outer side: Spark takes an exploded df for as
    small as the file that it comes from, and an inner join would let it broadcast all of it.
    """
    from pyspark.sql import Window as W

    first = df.groupBy(key).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), *also)
    ranges = written(first.where(F.col(key).isNotNull()).withColumns({"__lo": F.col("__lo") - widen, "__hi": F.col("__hi") + widen}), "ranges")
    placed = df.where(F.col(key).isNotNull()).select(key, x).join(ranges.select(key, "__lo", "__hi"), key, "left")
    place = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)).cast("int")
    counts = placed.withColumn("__bin", place).groupBy(key, "__bin", "__lo", "__hi").agg(F.count("*").alias("__n"))
    by = W.partitionBy(key).orderBy("__bin")
    counts = counts.withColumn("__run", F.sum("__n").over(by)).withColumn("__all", F.sum("__n").over(W.partitionBy(key)))
    edge = F.col("__lo") + F.col("__bin") * ((F.col("__hi") - F.col("__lo")) / bins)
    found = counts.groupBy(key).agg(*[F.min(F.when(F.col("__run") >= q * F.col("__all"), edge)).alias(name) for name, q in quantiles.items()])
    return found.join(ranges.drop("__lo", "__hi"), key, "left") if also else found


def extremum(value: str, row: str, dim: Column | None = None) -> Column:
    """struct(value, row, dim): the greatest absolute value and where, the first in row-major order of equals; zeros if there is none."""
    dim = F.lit(0) if dim is None else dim
    size = F.abs(F.col(value)).cast("double")
    best = F.max_by(F.struct(size.alias("value"), F.col(row).cast("long").alias("row"), dim.cast("long").alias("dim")), F.when(size.isNotNull(), F.struct(size, -F.col(row), -dim)))
    return F.coalesce(best, F.struct(F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("dim")))


def exact_percentiles(df: DataFrame, keys: list[str], x: str, quantiles: dict[str, float], bins: int = 5000) -> DataFrame:
    """keys and, for each name, the linear percentile of x, without a list of a group's values in any task.

    Counts by bin say which bins hold the two values around each quantile; only those bins' distinct values are ordered.
    Null values don't count; keys without values are left out.
    """
    from pyspark.sql import Window as W

    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    if not keys:
        rows, made = rows.withColumn("__k", F.lit(0)), ["__k"]
    else:
        made = keys
    ranges = rows.groupBy(*made).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("__n"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__lo")) / width))).otherwise(F.lit(0)).cast("int")
    values = rows.join(ranges, made).withColumn("__bin", place).groupBy(*made, "__bin", "__x").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    counts = values.groupBy(*made, "__bin").agg(F.sum("__c").alias("__c"), F.first("__n").alias("__n"))
    by = W.partitionBy(*made).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(by), F.lit(0)))
    at = lambda q: F.floor(F.lit(float(q)) * (F.col("__n") - 1))
    low, high = (lambda q: at(q)), (lambda q: F.least(at(q) + 1, F.col("__n") - 1))
    holds = lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__c"))
    needed = None
    for q in quantiles.values():
        found = holds(low(q)) | holds(high(q))
        needed = found if needed is None else needed | found
    few = values.drop("__n").join(counts.where(needed).select(*made, "__bin", "__before", "__n"), [*made, "__bin"])
    inside = W.partitionBy(*made, "__bin").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)
    few = few.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    value = lambda k: F.max(F.when(holds(k), F.col("__x")))
    share = lambda q: F.lit(float(q)) * (F.first("__n") - 1) - F.floor(F.lit(float(q)) * (F.first("__n") - 1))
    out = few.groupBy(*made).agg(*[(value(low(q)) + (value(high(q)) - value(low(q))) * share(q)).alias(name) for name, q in quantiles.items()])
    return out.select(*keys, *quantiles)


def nonfinite_census(x: str) -> list[Column]:
    """How many values, how many of them NaN and how many infinite."""
    v = F.col(x)
    return [F.count(v).alias("n"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf")]


def drift(diff: str, dim: str, real: int) -> list[Column]:
    """Against a stored reference: the greatest difference, that and the mean of the first `real` dimensions, whether all are equal."""
    d = F.abs(F.col(diff))
    own = F.when(F.col(dim) < real, d)
    return [F.max(d).alias("max_all"), F.max(own).alias("max_real"), F.avg(own).alias("mean_real"), F.bool_and(F.col(diff) == 0).alias("exact")]


def postfix_mean(loss, prefix) -> Column:
    """Losses of a chunk without its clean prefix, weighted so that their mean is the mean of the rest."""
    loss, prefix = (F.col(c) if isinstance(c, str) else c for c in (loss, prefix))
    rest = F.greatest(F.size(loss) - prefix, F.lit(1))
    return F.transform(loss, lambda x, i: F.when(i < prefix, F.lit(0.0)).otherwise(x * F.size(loss) / rest))


def summary(x: str) -> list[Column]:
    return [F.min(x).alias("minimum"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.99).alias("q99"), F.percentile(x, 0.999).alias("q999"), F.max(x).alias("maximum")]


def errors(diff: str) -> list[Column]:
    """Mean, root mean square, 95th percentile and maximum of absolute differences."""
    d = F.abs(F.col(diff))
    return [F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.percentile(d, 0.95).alias("p95"), F.max(d).alias("max_abs")]
