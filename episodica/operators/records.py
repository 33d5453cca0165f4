"""Validity of records, requests and comparisons as lists of reasons: an empty list is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_offset, timestamp

#: What a record may say.
KINDS = ("fact", "observation", "lesson", "procedure")
STATUSES = ("candidate", "verified", "stale", "superseded", "rejected")
RECHECKS = ("always", "on_change")
VERDICTS = ("supported", "refuted", "inconclusive")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), F.lit(name)) for name, fine in checks.items()]))


def first_reason(checks: dict[str, Column]) -> Column:
    return F.get(reasons(checks), F.lit(0))


def _text(c: str) -> Column:
    return F.length(F.trim(F.col(c))) > 0


def record_checks(now) -> dict[str, Column]:
    """For records (id, claim, owner, kind, status, scope map, observed_at, recorded_at, recheck, valid_until, evidence: array of
    (sha256, expected), depends_on: the same, supersedes array), in the order in which they are reported."""
    observed, recorded, until = timestamp("observed_at"), timestamp("recorded_at"), timestamp("valid_until")
    same = lambda c: F.forall(c, lambda e: e["sha256"].eqNullSafe(e["expected"]) & e["sha256"].isNotNull())
    return {
        "identity": _text("id") & _text("claim") & _text("owner"),
        "kind": F.col("kind").isin(*KINDS),
        "status": F.col("status").isin(*STATUSES),
        "scope": F.try_element_at("scope", F.lit("project")).isNotNull() & F.forall(F.map_entries("scope"), lambda e: (F.length(e["key"]) > 0) & (F.length(e["value"]) > 0)),
        "timezone": has_offset("observed_at") & has_offset("recorded_at"),
        "timeline": (observed <= now) & (recorded <= now) & (observed <= recorded),
        "recheck": F.col("recheck").isin(*RECHECKS),
        "expired": F.col("valid_until").isNull() | (until > now),
        "supersedes": F.forall("supersedes", lambda x: x.isNotNull() & (x != "") & (x != F.col("id"))),
        "evidence": F.col("evidence").isNotNull() & ((F.col("status") != "verified") | (F.size("evidence") > 0)),
        "fingerprint": same("evidence"),
        "dependencies": (F.col("recheck") != "on_change") | (F.size("depends_on") > 0),
        "dependency_changed": F.col("depends_on").isNull() | same("depends_on"),
    }


def attempt_checks() -> dict[str, Column]:
    """For the optional block attempt: struct(symptom, verdict), which only lessons have."""
    none = F.col("attempt").isNull()
    return {
        "attempt_kind": none | (F.col("kind") == "lesson"),
        "attempt_text": none | (F.length(F.trim("attempt.symptom")) > 0),
        "attempt_verdict": none | F.col("attempt.verdict").isin(*VERDICTS),
    }


def request_checks(state: str, prompt: str, dims: int) -> dict[str, Column]:
    finite = F.forall(state, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return {"state_size": F.size(state) == dims, "state_finite": finite, "prompt": _text(prompt)}


def tick_checks(delay: str, observed: str, target: str, committed: str, prefix: str, max_delay: int, horizon: int) -> dict[str, Column]:
    """A request that continues committed actions: three equal ticks, a delay within the trained range, as long a prefix."""
    d = F.col(delay)
    return {
        "delay": (d >= 0) & (d <= max_delay) & (d < horizon),
        "observed_tick": F.col(observed) >= 0,
        "target_tick": F.col(target) == F.col(observed),
        "committed_tick": F.col(committed) == F.col(target),
        "prefix": F.size(prefix) == d,
    }


def clamp_delays(d: str, s: str, horizon: int) -> tuple[Column, Column, Column]:
    """(d, s, warnings): d within [0, horizon], then s within [d, horizon - d], the upper bound last."""
    start = F.greatest(F.floor(F.col(d)), F.lit(0)).cast("long")
    d_out = F.least(start, F.lit(horizon).cast("long"))
    s_in = F.floor(F.col(s)).cast("long")
    s_up = F.greatest(s_in, d_out)
    s_out = F.least(s_up, F.greatest(F.lit(horizon).cast("long") - d_out, F.lit(0).cast("long")))
    said = F.array(
        F.when(F.col(d) != F.floor(F.col(d)), F.lit("d rounded")),
        F.when(F.col(s) != F.floor(F.col(s)), F.lit("s rounded")),
        F.when(start > horizon, F.lit("d clamped")),
        F.when(s_in < d_out, F.lit("s raised")),
        F.when(s_up > s_out, F.lit("s clamped")),
    )
    return d_out, s_out, F.array_compact(said)


def fit_length(a: str, n: Column, empty: Column) -> Column:
    """The last n items, or all of them and the last one repeated; `empty` repeated if there is none."""
    a = F.col(a)
    last = F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))).otherwise(empty)
    return F.when(F.size(a) >= n, F.slice(a, F.size(a) - n + 1, n)).otherwise(F.concat(a, F.array_repeat(last, F.greatest(n - F.size(a), F.lit(0)).cast("int"))))


def joint_step_checks(state, chunk, delay, joints: list[int], limit: float) -> tuple[Column, Column]:
    """(greatest step of a joint, whether it is within the limit) over the new part of a chunk of vectors.

    Steps begin at the last committed vector, or at the state if nothing is committed.
    """
    state, chunk, delay = (F.col(c) if isinstance(c, str) else c for c in (state, chunk, delay))
    first = F.when(delay > 0, F.get(chunk, delay - 1)).otherwise(state)
    new = F.slice(chunk, delay + 1, F.greatest(F.size(chunk) - delay, F.lit(0)))
    both = F.arrays_zip(F.concat(F.array(first), F.slice(new, F.lit(1), F.greatest(F.size(new) - 1, F.lit(0)))).alias("a"), new.alias("b"))
    step = lambda e: F.array_max(F.array(*[F.abs(F.get(e["a"], F.lit(j)) - F.get(e["b"], F.lit(j))) for j in joints]))
    worst = F.coalesce(F.array_max(F.transform(both, step)), F.lit(0.0))
    return worst, worst <= limit


def identity_relation(saved: Column, expected: Column) -> Column:
    """How saved text relates to an expected sha256: the same, the same but for one closing line end, or another text."""
    bytes_ = saved.cast("binary")
    close = ~saved.endswith("\n") & (F.sha2(F.concat(bytes_, F.lit("\n").cast("binary")), 256) == expected)
    return F.when(F.sha2(bytes_, 256) == expected, "identical").when(close, "without_last_line_end").otherwise("differs")


def safe_identifier(c) -> Column:
    """A plain name, or a relative path that stays below its root."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~F.exists(F.split(c, "/", -1), lambda x: x.isin("", ".", ".."))


def confounders(reference: DataFrame, candidate: DataFrame, pair: str, must: list[str], may: list[str], cross: bool) -> DataFrame:
    """pair, differs (keys that must match), runtime (keys that may differ only across backends), comparable."""
    a, b = (df.select(pair, *[F.col(c).alias(f"{p}{c}") for c in (*must, *may)]) for df, p in ((reference, "a_"), (candidate, "b_")))
    differ = lambda keys: F.array_compact(F.array(*[F.when(~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), F.lit(k)) for k in keys]))
    out = a.join(b, pair).select(pair, differ(must).alias("differs"), differ(may).alias("runtime"))
    return out.withColumn("comparable", (F.size("differs") == 0) & (F.lit(cross) | (F.size("runtime") == 0)))


def promotion_checks(cases: str, expected_delays: list[int], n_cases: int, most: float, p99: float) -> dict[str, Column]:
    """A candidate goes on if all expected cases ran, are finite and keep the prefix, and the differences are small enough.

    cases: array of struct(delay, finite, prefix_exact); and max_abs, p99_abs, engine_sha256, report_sha256.
    """
    return {
        "identity": F.col("engine_sha256") == F.col("report_sha256"),
        "cases": F.size(cases) == n_cases,
        "delays": F.array_sort(F.array_distinct(F.transform(cases, lambda c: c["delay"]))) == F.array(*[F.lit(d) for d in sorted(expected_delays)]),
        "finite": F.forall(cases, lambda c: c["finite"]),
        "prefix_exact": F.forall(cases, lambda c: c["prefix_exact"]),
        "max_abs": ~F.isnan("max_abs") & (F.col("max_abs") <= most),
        "p99_abs": ~F.isnan("p99_abs") & (F.col("p99_abs") <= p99),
    }
