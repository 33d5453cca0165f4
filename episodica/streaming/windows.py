"""Tumbling, sliding and session windows. On a stream, pass a watermark; timestamps without zone are taken as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark) if watermark else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], value: str, *, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """start, keys, n and total of each window; overlapping windows with slide."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = timed(df, ts, watermark).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str, *, watermark: str | None = None) -> DataFrame:
    """start and n of each session of a key: rows with less than the gap between neighbours."""
    out = timed(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def rollback_stream(df: DataFrame, run: str, order: str, step: str, value: str) -> DataFrame:
    """The rollback rule on a stream: each micro-batch emits a run's current (step, value) rows with its version.

    The state holds what stays, at most one row a step; within a batch rows are taken by `order`.
    """
    import pandas as pd

    def update(key, parts, state):
        stack = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        for s, v in zip(rows[step].tolist(), rows[value].tolist(), strict=True):
            if stack and stack[-1][0] == s:
                v = v if pd.notna(v) else stack[-1][1]
            while stack and stack[-1][0] >= s:
                stack.pop()
            stack.append((s, v))
        state.update(([s for s, _ in stack], [v for _, v in stack]))
        yield pd.DataFrame({run: [key[0]] * len(stack), step: [s for s, _ in stack], value: [v for _, v in stack]})

    kind = df.schema[run].dataType.simpleString()
    return df.groupBy(run).applyInPandasWithState(update, f"`{run}` {kind}, `{step}` long, `{value}` double", "steps array<long>, vals array<double>", "append", "NoTimeout")
