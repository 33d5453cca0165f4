"""Models in a plan: what a policy is, how it is applied in Arrow batches, and a retry for one kind of failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Policy(Protocol):
    """Infers one row of output for each row of input; reset forgets what was seen."""

    def infer(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def reset(self) -> None: ...


class Linear:
    """The weighted sum of a vector, for tests and as a pattern."""

    def __init__(self, weights: list[float], column: str):
        self.weights, self.column = weights, column

    def infer(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": [float(sum(w * x for w, x in zip(self.weights, v, strict=False))) for v in batch[self.column]]})

    def reset(self) -> None:
        return None


def infer(df: DataFrame, policy: Policy, keys: list[str], inputs: list[str], schema: str) -> DataFrame:
    """keys and the policy's outputs. The policy goes to each task once, and is reset there."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy.reset()
        for part in parts:
            yield pd.concat([part[keys].reset_index(drop=True), policy.infer(part[inputs])], axis=1)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, f"{kinds}, {schema}")


def guarded(call: Callable, fallback: Callable, message: str) -> Callable:
    """call, and fallback in its place for errors that say `message`; any other error goes on."""

    def run(value):
        try:
            return call(value)
        except RuntimeError as error:
            if message not in str(error):
                raise
            return fallback(value)

    return run


def previous_time(connection: str, order: str, spent: str) -> Column:
    """What the request before on the same connection took: requests of a connection are served one after the other."""
    return F.lag(spent).over(W.partitionBy(connection).orderBy(order))
