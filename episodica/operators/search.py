"""Lexical search over records, and packing of its results under a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_score


def query_terms(text: str) -> list[str]:
    """Distinct words of a query in their first order, case-folded."""
    import re

    return list(dict.fromkeys(re.findall(r"\w+", text.casefold())))


def search(records: DataFrame, key: str, text: str, query: str, top: int) -> DataFrame:
    """The best records by the number of query terms that they contain as substrings; ties by key."""
    scored = records.select(key, term_score(text, query_terms(query)).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(top)


def scope_matches(scope: str, wanted: dict[str, str]) -> Column:
    """Every key of a record's scope equals the query's."""
    q = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]) if wanted else F.create_map().cast("map<string,string>")
    return F.forall(F.map_entries(scope), lambda e: F.try_element_at(q, e["key"]).eqNullSafe(e["value"]))


def pack(rows: list[tuple[str, str]], budget: int) -> list[str]:
    """Keys of ranked (key, json) rows that fit, one after the other; what doesn't fit is skipped, not the end. At most a top-k goes in."""
    out, used = [], 0
    for key, text in rows:
        size = len(text.encode())
        if used + size <= budget:
            out.append(key)
            used += size
    return out
