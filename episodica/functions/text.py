"""Text functions: prompts, names, terms, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import col


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean_prompt(c) -> Column:
    """Stripped, underscores and newlines as spaces."""
    return F.translate(strip(c), "_\n", "  ")


def clean_prompt_lower(c) -> Column:
    """Stripped and lowered, underscores as spaces; newlines stay."""
    return F.translate(F.lower(strip(c)), "_", " ")


def render_prompt(task, bins) -> Column:
    return F.concat(F.lit("Task: "), col(task), F.lit(", State: "), F.array_join(F.transform(col(bins), lambda b: b.cast("string")), " "), F.lit(";"))


def answer(c) -> Column:
    """What stands after the first `Action: `, up to the next one or a bar, stripped; null without it."""
    parts = F.split(col(c), "Action: ", -1)
    return F.when(F.size(parts) > 1, strip(F.get(F.split(F.get(parts, F.lit(1)), "\\|", -1), F.lit(0))))


def safe_name(c) -> Column:
    safe = F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(safe == "", F.lit("metric")).otherwise(safe)


def chunk_path(episode, size: int = 1000) -> Column:
    e = col(episode).cast("long")
    return F.format_string("data/chunk-%03d/file-%03d.parquet", F.floor(e / size), e % size)


def terms(c) -> Column:
    """Case-folded distinct words in their first order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def term_score(text, words: list[str]) -> Column:
    """How many of the terms the text contains, as substrings."""
    low = F.lower(col(text))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def number_text(x) -> Column:
    """For reports: a dash for missing values, 6 decimals or, below 1e-4, 8 ones without closing zeros, an exponent below 1e-8.

    Values that aren't finite, or are below 0, fail.
    """
    x = col(x)
    plain = F.when(x < 1e-4, F.format_string("%.8f", x)).otherwise(F.format_string("%.6f", x))
    shown = F.when(x == 0, F.lit("0")).when(x < 1e-8, F.regexp_replace(F.format_string("%.2e", x), r"\.?0+e", "e")).otherwise(F.regexp_replace(plain, r"\.?0+$", ""))
    fine = ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return F.when(x.isNull(), F.lit("—")).when(fine, shown).otherwise(F.raise_error(F.lit("report numbers must be finite and not below 0")))


def latency_text(x) -> Column:
    return F.when(col(x).isNull(), F.lit("—")).otherwise(F.format_number(col(x), 2))


def has_offset(c) -> Column:
    """Whether an ISO timestamp names its offset from UTC."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def timestamp(c) -> Column:
    """The instant; null unless the text names its offset."""
    return F.when(has_offset(c), F.try_to_timestamp(col(c)))


def template(text: str, values: dict) -> Column:
    """text with {name} replaced; a placeholder that values lack fails when the plan is made."""
    import re

    parts = re.split(r"\{(\w+)\}", text)
    missing = [n for n in parts[1::2] if n not in values]
    if missing:
        raise KeyError(f"no value for {missing}")
    return F.concat(*[F.lit(p) if k % 2 == 0 else col(values[p]).cast("string") for k, p in enumerate(parts)])


def json_size(*columns: str) -> Column:
    """Bytes of a row's JSON and its line end: what it takes of a budget."""
    return F.octet_length(F.to_json(F.struct(*columns))) + 1


def parse_spec(spec: str | None) -> list[int] | None:
    """`a:b`, `a:b:c` or `a,b,c` as numbers; None stands for all."""
    if spec is None:
        return None
    if ":" in spec:
        return list(range(*[int(x) for x in spec.split(":")]))
    return [int(x) for x in spec.split(",")]


def parse_range(text: str) -> tuple[int, int]:
    start, end = (int(x) for x in text.split(":"))
    if not 0 <= start < end:
        raise ValueError("expected START:END with 0 <= START < END")
    return start, end


def section(lines: list[str], heading: str) -> str | None:
    """The lines from the heading up to the next one of its level or above; None unless exactly one line is that heading.

    Lines of fenced blocks are no headings; a fence closes with at least as many of its own marks.
    """
    import re

    found, fence = [], ""
    for at, line in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})([^\n]*)", line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence) and not mark[2].strip():
                fence = ""
        elif not fence and (title := re.match(r"(#{1,6}) (.+?)\s*$", line)):
            found.append((at, len(title[1]), title[2]))
    mine = [k for k, (_, _, title) in enumerate(found) if title == heading]
    if len(mine) != 1:
        return None
    start, level, _ = found[mine[0]]
    return "".join(lines[start : next((at for at, depth, _ in found[mine[0] + 1 :] if depth <= level), len(lines))])


def sections(df, key: str, text: str, heading: str):
    """(key, section) of each document; null where the heading is missing or stands twice."""
    import pandas as pd

    def run(parts):
        for part in parts:
            yield pd.DataFrame({key: part[key], "section": [None if t is None else section(t.splitlines(keepends=True), heading) for t in part[text]]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, section string")


def warmup_cosine(step, warmup: int, peak: float, total: int, end: float) -> Column:
    """Linear warm-up, then a cosine decay to end."""
    s = col(step).cast("double")
    start = peak / (warmup + 1)
    rest = F.least(F.greatest((s - warmup) / (total - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(s < warmup, start + (peak - start) * s / warmup).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * rest)))


def rsqrt_decay(step, warmup: int, peak: float, timescale: float) -> Column:
    s = col(step).cast("double")
    start = peak / (warmup + 1)
    return F.when(s < warmup, start + (peak - start) * s / warmup).otherwise(peak / F.sqrt((timescale + (s - warmup)) / timescale))
