"""Transforms of samples as select lists: repack, rename, normalize, pad, and pipelines with their inverse."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A

Transform = Callable[[DataFrame], DataFrame]


def paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path joined by /, column expression) of every leaf."""
    out = []
    for f in schema.fields:
        name, at = (f"{prefix}/{f.name}" if prefix else f.name), f.name
        if isinstance(f.dataType, T.StructType):
            out += [(f"{name}/{p}", f"`{at}`.{c}") for p, c in paths(f.dataType)]
        else:
            out.append((name, f"`{at}`"))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns named by their path, a/b/c."""
    return df.select(*[F.col(c).alias(p) for p, c in paths(df.schema)])


def unflatten(df: DataFrame) -> DataFrame:
    """The inverse: columns a/b as structs. A name that is both a leaf and a node fails."""

    def build(columns: list[tuple[list[str], str]]) -> list[Column]:
        out, heads = [], list(dict.fromkeys(c[0][0] for c in columns))
        for head in heads:
            inside = [(p[1:], name) for p, name in columns if p[0] == head]
            if any(not p for p, _ in inside) and len(inside) > 1:
                raise ValueError(f"{head} is a leaf and a node")
            out.append(F.col(f"`{inside[0][1]}`").alias(head) if not inside[0][0] else F.struct(*build(inside)).alias(head))
        return out

    return df.select(*build([(c.split("/"), c) for c in df.columns]))


def repack(tree: dict) -> Transform:
    """A target tree whose leaves are source paths; a missing source fails when the plan is made."""

    def apply(df: DataFrame) -> DataFrame:
        have = dict(paths(df.schema))

        def build(node: dict) -> list[Column]:
            return [(F.struct(*build(v)) if isinstance(v, dict) else F.col(have[v])).alias(k) for k, v in node.items()]

        missing = [v for v in _leaves(tree) if v not in have]
        if missing:
            raise KeyError(f"no such source: {missing}")
        return df.select(*build(tree))

    return apply


def _leaves(tree: dict) -> list[str]:
    return [x for v in tree.values() for x in (_leaves(v) if isinstance(v, dict) else [v])]


def rename(patterns: Sequence[tuple[str, str | None]]) -> Transform:
    """Flat names by the first pattern that matches as a whole; None drops the column. Two columns of one name fail."""

    def apply(df: DataFrame) -> DataFrame:
        out: dict[str, str] = {}
        for name in df.columns:
            new = name
            for pattern, target in patterns:
                if found := re.fullmatch(pattern, name):
                    new = None if target is None else found.expand(target)
                    break
            if new is not None:
                if new in out:
                    raise ValueError(f"{name} and {out[new]} both become {new}")
                out[new] = name
        return df.select(*[F.col(f"`{old}`").alias(new) for new, old in out.items()])

    return apply


def apply_to(functions: dict[str, Callable[[Column], Column]], strict: bool = False) -> Transform:
    """Functions for the columns that are there; strict: a missing one fails."""

    def apply(df: DataFrame) -> DataFrame:
        missing = [k for k in functions if k not in df.columns]
        if strict and missing:
            raise KeyError(f"no such column: {missing}")
        return df.withColumns({k: f(F.col(f"`{k}`")) for k, f in functions.items() if k in df.columns})

    return apply


def default_prompt(text: str, name: str = "prompt") -> Transform:
    """A prompt where there is none: no column, or a null in it."""
    return lambda df: df.withColumn(name, F.coalesce(F.col(name), F.lit(text)) if name in df.columns else F.lit(text))


def drop_strings(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.StringType)])


def compose(*steps: Transform) -> Transform:
    def apply(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return apply


@dataclass(frozen=True)
class Pipeline:
    """Forward steps, and backward ones that undo them: what is pushed last is undone first."""

    forward: tuple[Transform, ...] = ()
    backward: tuple[Transform, ...] = ()

    def push(self, forward: Sequence[Transform] = (), backward: Sequence[Transform] = ()) -> Pipeline:
        return Pipeline((*self.forward, *forward), (*backward, *self.backward))

    def apply(self, df: DataFrame) -> DataFrame:
        return compose(*self.forward)(df)

    def undo(self, df: DataFrame) -> DataFrame:
        return compose(*self.backward)(df)


@dataclass
class Registry:
    """Named builders; an unknown name fails with the closest known one."""

    builders: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, build: Callable) -> None:
        if name in self.builders:
            raise ValueError(f"{name} exists")
        self.builders[name] = build

    def get(self, name: str, **options):
        if name not in self.builders:
            near = difflib.get_close_matches(name, self.builders, n=1)
            raise KeyError(f"no configuration {name}" + (f"; did you mean {near[0]}?" if near else ""))
        return self.builders[name](**options)


def normalizer(mean: Sequence[float], std: Sequence[float], column: str) -> tuple[Transform, Transform]:
    return apply_to({column: lambda c: A.zscore(c, mean, std)}), apply_to({column: lambda c: A.unzscore(c, mean, std)})


def relative(state: str, action: str, mask: Sequence[bool]) -> tuple[Transform, Transform]:
    return (lambda df: df.withColumn(action, A.delta(state, action, mask))), (lambda df: df.withColumn(action, A.absolute(state, action, mask)))


def padder(n: int, real: int, column: str) -> tuple[Transform, Transform]:
    return apply_to({column: lambda c: A.pad(c, n)}), apply_to({column: lambda c: A.head(c, real)})


def committed_prefix(mean: Sequence[float], std: Sequence[float], mask: Sequence[bool], real: int, n: int, state: str = "state", action: str = "action") -> Pipeline:
    """Relative actions, normalized, padded to n; backward to the first `real` dimensions."""
    out = Pipeline()
    for forward, backward in (relative(state, action, mask), normalizer(mean, std, action), padder(n, real, action)):
        out = out.push([forward], [backward])
    return out


#: Configurations by name; options: mean, std, mask, real, n.
CONFIGURATIONS = Registry()
CONFIGURATIONS.add("committed_prefix", committed_prefix)
CONFIGURATIONS.add("relative_actions", lambda mask, state="state", action="action": Pipeline(*[(t,) for t in relative(state, action, mask)]))


def robot_input(df: DataFrame, state: str, views: dict[str, str | None], family: str, size: int = 12) -> DataFrame:
    """State, images and masks as a model takes them. A view without a column is an image of zeros, masked out unless the
    family keeps it."""
    out = {"state": F.col(state)}
    for view, column in views.items():
        out[f"image_{view}"] = F.col(column) if column else F.lit(bytes(size))
        out[f"mask_{view}"] = F.lit(True) if column else view_mask(F.lit(family))
    return df.withColumns(out)


def view_mask(family) -> Column:
    """Whether a missing view still counts as seen: it does for the token-based family alone."""
    return A.col(family) == "fast"
