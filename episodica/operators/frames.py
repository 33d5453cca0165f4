"""Episode and frame tables: numbering, windows, audits, repair. An episode is one key's rows in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import running


def number(df: DataFrame, episode: str, order: list[str], out: str = "frame") -> DataFrame:
    """Frames counted from 0 within each episode."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(episode).orderBy(*order)) - 1)


def future_chunk(df: DataFrame, episode: str, frame: str, value: str, horizon: int, out: str = "chunk") -> DataFrame:
    """The next `horizon` values from each frame on; past the end the last one is repeated."""
    ahead = F.collect_list(value).over(W.partitionBy(episode).orderBy(frame).rowsBetween(0, horizon - 1))
    df = df.withColumn(out, ahead)
    return df.withColumn(out, F.concat(out, F.array_repeat(F.element_at(out, -1), F.lit(horizon) - F.size(out))))


def full_windows(df: DataFrame, episode: str, frame: str, value: str, horizon: int, out: str = "chunk") -> DataFrame:
    """Only frames with a whole window ahead, nothing repeated."""
    ahead = F.collect_list(value).over(W.partitionBy(episode).orderBy(frame).rowsBetween(0, horizon - 1))
    return df.withColumn(out, ahead).where(F.size(out) == horizon)


def adjacent_diff(df: DataFrame, episode: str, frame: str, value: str, out: str = "diff") -> DataFrame:
    """The step from the frame before; null on the first frame."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(W.partitionBy(episode).orderBy(frame)))


def episode_ranges(df: DataFrame, episode: str, length: str) -> DataFrame:
    """[index_from, index_to) of each episode in one global numbering. One row an episode goes in."""
    return running(df, [F.col(episode)], length, "index_from").withColumn("index_to", F.col("index_from") + F.col(length))


def time_ok(time, frame, fps: float, atol: float, rtol: float = 0.0) -> Column:
    want = F.col(frame) / fps
    return F.abs(F.col(time) - want) <= atol + rtol * F.abs(want)


def trim_tail(df: DataFrame, episode: str, frame: str, time: str, fps: float, count: str) -> DataFrame:
    """Frames before the first one whose time belongs to a picture that isn't there."""
    first = F.min(F.when(F.rint(F.col(time) * fps) >= F.col(count), F.col(frame))).over(W.partitionBy(episode))
    return df.withColumn("__cut", first).where(F.col("__cut").isNull() | (F.col(frame) < F.col("__cut"))).drop("__cut")


def first_failure(checks: list[tuple[str, Column]], passed: str) -> Column:
    """The name of the first check that holds, in their order."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks], F.lit(passed))


def probe_frames(n: str, horizon: int) -> Column:
    """First, middle, last whole window, last: distinct and sorted."""
    n = F.col(n).cast("long")
    return F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2), F.greatest(F.lit(0).cast("long"), n - horizon), n - 1)))


def take_until(df: DataFrame, order: list[Column], length: str, target: float) -> DataFrame:
    """Whole episodes in the given order until the target is reached; the one that crosses it is included. All of them must reach it."""
    total = df.agg(F.sum(length)).first()[0] or 0
    if total < target:
        raise ValueError(f"all episodes together have {total}, less than {target}")
    return running(df, order, length, "__before").where(F.col("__before") < target).drop("__before")


def tail_padding(chunk: str, frame: str, n: str, horizon: int) -> tuple[Column, Column]:
    """(how many steps of a chunk lie past the end, whether its last two are equal as they then must be)."""
    steps = F.greatest(F.lit(0), F.col(frame) + horizon - F.col(n)).cast("int")
    return steps, F.element_at(chunk, -1).eqNullSafe(F.element_at(chunk, -2))


def seam_jump(chunk: str, before: Column, joints: list[int]) -> Column:
    """The greatest step of a joint from the state before a chunk of vectors to its first one."""
    first = F.get(chunk, F.lit(0))
    return F.array_max(F.array(*[F.abs(F.get(first, F.lit(j)) - F.get(before, F.lit(j))) for j in joints]))


def chunk_step(row: Column, horizon: int) -> tuple[Column, Column]:
    """(which chunk, which step of it) serves a request when chunks are asked for one after the other."""
    return F.floor(row / horizon), row % horizon
