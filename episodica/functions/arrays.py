"""Transforms of vector columns (array<double>) and of chunks (array<array<double>>), as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def subsample(a, stride: int) -> Column:
    """Every stride-th element, the first included."""
    return F.filter(col(a), lambda _, i: i % stride == 0)


def pad(a, n: int, value: float = 0.0) -> Column:
    """Filled up to n with value; never shortened."""
    a = col(a)
    return F.concat(a, F.array_repeat(F.lit(float(value)), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def head(a, n: int) -> Column:
    return F.slice(col(a), 1, n)


def bool_mask(*runs: int) -> list[bool]:
    """n true values for n, n false ones for -n, nothing for 0."""
    return [run > 0 for run in runs for _ in range(abs(run))]


def _masked(state, a, mask: Sequence[bool] | None, sign: int) -> Column:
    state, a = col(state), col(a)
    if mask is None:
        return a
    on = F.array(*[F.lit(bool(m)) for m in mask])
    return F.transform(a, lambda x, i: F.when(F.coalesce(F.get(on, i), F.lit(False)), x + sign * F.get(state, i)).otherwise(x))


def delta(state, action, mask: Sequence[bool] | None) -> Column:
    """Masked dimensions relative to the state; dimensions beyond the mask, or all without one, stay."""
    return _masked(state, action, mask, -1)


def absolute(state, action, mask: Sequence[bool] | None) -> Column:
    """The inverse of delta."""
    return _masked(state, action, mask, 1)


def chunk_delta(state, chunk, mask: Sequence[bool] | None) -> Column:
    """delta for every step of a chunk, always against the current state."""
    return F.transform(col(chunk), lambda step: _masked(state, step, mask, -1))


def swap_halves(a, n: int = 7) -> Column:
    """The first n elements change places with the next n; too short arrays stay."""
    a = col(a)
    return F.when(F.size(a) < 2 * n, a).otherwise(F.concat(F.slice(a, n + 1, n), F.slice(a, 1, n), F.slice(a, 2 * n + 1, F.greatest(F.size(a) - 2 * n, F.lit(0)))))


def flip(a, signs: Sequence[float]) -> Column:
    return F.zip_with(col(a), doubles(signs), lambda x, s: x * s)


def zscore(a, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean) / (std + eps), with the statistics cut to the array's length."""
    m, s = doubles(mean), doubles(std)
    return F.transform(col(a), lambda x, i: (x - F.get(m, i)) / (F.get(s, i) + EPS))


def unzscore(a, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Inverse; dimensions beyond the statistics have mean 0 and deviation 1."""
    m, s = doubles(mean), doubles(std)
    return F.transform(col(a), lambda x, i: x * (F.coalesce(F.get(s, i), F.lit(1.0)) + EPS) + F.coalesce(F.get(m, i), F.lit(0.0)))


def quantile_scale(a, low: Sequence[float], high: Sequence[float]) -> Column:
    """To [-1, 1] between two quantiles, without clipping."""
    lo, hi = doubles(low), doubles(high)
    return F.transform(col(a), lambda x, i: (x - F.get(lo, i)) / (F.get(hi, i) - F.get(lo, i) + EPS) * 2 - 1)


def unquantile_scale(a, low: Sequence[float], high: Sequence[float]) -> Column:
    """Inverse; dimensions beyond the statistics stay."""
    lo, hi = doubles(low), doubles(high)
    return F.transform(col(a), lambda x, i: F.when(F.get(lo, i).isNull(), x).otherwise((x + 1) / 2 * (F.get(hi, i) - F.get(lo, i) + EPS) + F.get(lo, i)))


def digitize(x) -> Column:
    """The bin of 256 on [-1, 1]: -1 below, 255 from the last one on."""
    return F.greatest(F.lit(-1), F.least(F.lit(255), F.floor((col(x) + 1) * 128))).cast("int")


def all_finite(a) -> Column:
    return F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def pad_tokens(a, n: int, value: int = 0) -> tuple[Column, Column]:
    """(exactly n tokens, which of them are real)."""
    a = col(a)
    have = F.least(F.size(a), F.lit(n))
    tokens = F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(value).cast("int"), F.lit(n) - have))
    return tokens, F.concat(F.array_repeat(F.lit(True), have), F.array_repeat(F.lit(False), F.lit(n) - have))


def roll_right(a, valid) -> Column:
    """The first `valid` elements moved to the end."""
    a, valid = col(a), col(valid)
    return F.concat(F.slice(a, valid + 1, F.greatest(F.size(a) - valid, F.lit(0))), F.slice(a, 1, valid))


def put(a, index, value) -> Column:
    index = col(index)
    return F.transform(col(a), lambda x, i: F.when(i == index, value).otherwise(x))


def mixed_radix(digits, levels: Sequence[int]) -> Column:
    """Digits, the least significant first, as one number."""
    base = [1]
    for n in levels[:-1]:
        base.append(base[-1] * n)
    return F.aggregate(F.zip_with(col(digits), F.array(*[F.lit(b) for b in base]), lambda d, b: (d * b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def radix_digits(token, levels: Sequence[int]) -> Column:
    out, base = [], 1
    for n in levels:
        out.append(F.pmod(F.floor(col(token) / base), F.lit(n)).cast("int"))
        base *= n
    return F.array(*out)


def soft_weights(start: int, end: int, total: int) -> list[float]:
    """1 before start, an exponential decay up to end, 0 after."""
    import math

    out = []
    for k in range(total):
        c = min(max((start - 1 - k) / (end - start + 1) + 1, 0.0), 1.0)
        out.append(0.0 if k >= end else c * math.expm1(c) / math.expm1(1.0))
    return out


def weighted_sum(a) -> Column:
    """Sum of i * x with i from 1: a digest in which order counts."""
    return F.aggregate(F.transform(col(a), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def prefix_postfix_masks(prefix, postfix) -> tuple[Column, Column]:
    """(attention: 0 on the prefix and 1 behind, loss: false and true) of a prompt and its answer."""
    prefix, postfix = col(prefix), col(postfix)
    both = lambda a, b: F.concat(F.array_repeat(F.lit(a), prefix), F.array_repeat(F.lit(b), postfix))
    return both(0, 1), both(False, True)


def prefix_mask(n: int, delay) -> Column:
    """Which steps are committed already: those before the delay."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k < col(delay))


def position_ids(valid) -> Column:
    """The running number of valid tokens, from 0; -1 before the first."""
    valid = col(valid)
    return F.transform(valid, lambda _, i: F.size(F.filter(F.slice(valid, F.lit(1), i + 1), lambda x: x)) - 1)


def remap_tokens(tokens, vocabulary: int, skip: int) -> Column:
    """Tokens counted from the end of a vocabulary, its last `skip` ones left out; its own inverse."""
    return F.transform(col(tokens), lambda t: F.lit(vocabulary - 1 - skip) - t)


def decode_bins(tokens, steps: int, dims: int, bins: int) -> Column:
    """steps x dims values in [-1, 1] from bin numbers; zeros if there are too few, the surplus is left out."""
    t = col(tokens)
    rows = F.array(*[F.transform(F.slice(t, k * dims + 1, dims), lambda x: x / F.lit(float(bins)) * 2 - 1) for k in range(steps)])
    return F.when(F.size(t) < steps * dims, F.array_repeat(F.array_repeat(F.lit(0.0), dims), steps)).otherwise(rows)


def quantize(a, levels: Sequence[int]) -> Column:
    """For each dimension which of its levels tanh(x) is nearest to."""
    n = F.array(*[F.lit(x) for x in levels])
    return F.transform(col(a), lambda x, i: F.rint((F.tanh(x) + 1) * (F.get(n, i) - 1) / 2).cast("int"))


def dequantize(digits, levels: Sequence[int]) -> Column:
    n = F.array(*[F.lit(x) for x in levels])
    return F.transform(col(digits), lambda d, i: d / (F.get(n, i) - 1).cast("double") * 2 - 1)


def sincos(position, dim: int, shortest: float, longest: float) -> Column:
    """dim / 2 sines and as many cosines, with periods in geometric steps."""
    half = dim // 2
    if dim % 2:
        raise ValueError("the number of features must be even")
    rates = [2 * 3.141592653589793 / (shortest * (longest / shortest) ** (k / max(1, half - 1))) for k in range(half)]
    angles = F.transform(doubles(rates), lambda w: w * col(position))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def bytes_affine(a) -> Column:
    """0 to 255 as -1 to 1."""
    return F.transform(col(a), lambda x: x / F.lit(255.0) * 2 - 1)


#: Fixed values of the gripper maps: linear travel, arm and horn of the linkage, and the ranges of the angle.
TRAVEL, ARM, HORN, ANGLE, ROBOT_ANGLE = (0.01844, 0.05800), 0.036, 0.022, (0.5476, 1.6296), (-0.6213, 1.4910)


def gripper_to_angle(x) -> Column:
    """An opening from 0 to 1 of linear travel as the share of the angle's range."""
    reach = col(x) * (TRAVEL[1] - TRAVEL[0]) + TRAVEL[0]
    sine = (reach * reach + (HORN**2 - ARM**2)) / (reach * (2 * HORN))
    return (F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))) - ANGLE[0]) / (ANGLE[1] - ANGLE[0])


def gripper_from_angle(x) -> Column:
    return (col(x) + (ANGLE[0] - ROBOT_ANGLE[0])) / (ROBOT_ANGLE[1] - ROBOT_ANGLE[0])


def gripper_from_angle_inverse(x) -> Column:
    return col(x) * (ROBOT_ANGLE[1] - ROBOT_ANGLE[0]) + (ROBOT_ANGLE[0] - ANGLE[0])
