"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame expressions only. Positions come from splitting a text by the very pattern that is extracted: the pieces and
the matches alternate, so running lengths give each match's place in code points.

Kinds in their order: email, ip (parts of at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits): their
spans always stay; then iban (length of its country, mod 97) and ssn (a group of digits that only words nearby make
likely enough). Spans of one kind never overlap; of different kinds they may. Null texts have none.

The patterns are written with possessive repetition and look-behind where that can't change what matches: a run that
fails from its start fails from its middle too, so each text is read in linear time and without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must hold for a pattern to match at all.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
#: Score of a confirmed span, and what a word of its kind within CONTEXT characters adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT_WORDS = {"email": "mail|contact", "ip": "ip|server|host", "card": "card|visa|payment", "phone": "phone|call|tel|mobile", "iban": "iban|bank|account", "ssn": "ssn|social security"}
CONTEXT, BONUS, LEAST = 40, 0.2, 0.5
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(compact: Column) -> Column:
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """Whether a match stands: its checksum, its ranges, its number of digits."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        compact = F.replace(m, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        fits = F.coalesce(F.try_element_at(lengths, F.substr(compact, F.lit(1), F.lit(2))) == F.length(compact), F.lit(False))
        return F.when(fits, _mod97(compact)).otherwise(False)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind, in their order: array of structs, ends exclusive, in code points."""
    pattern = F.lit(PATTERNS[kind])
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        around = F.lower(F.concat(F.substring(text, F.greatest(begin - CONTEXT, F.lit(0)) + 1, F.least(begin, F.lit(CONTEXT))), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT))))
        score = F.lit(SCORES[kind]) + F.when(around.rlike(f"(?:^|[^a-z])(?:{CONTEXT_WORDS[kind]})"), BONUS).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), score.alias("score")).cast(SPAN)
        stands = confirmed(kind, x["m"])
        if kind not in BASE_KINDS:
            stands = stands & (score >= LEAST)
        return F.struct(end.alias("at"), F.when(stands, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    found = F.aggregate(pairs, start, add, lambda state: state["out"])
    return F.when(text.rlike(NEEDED[kind]) if kind != "email" else text.contains("@"), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, *, text_col: str = "text", out: str = "pii", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and one column out: a struct with an array of spans for each kind. Null texts have empty arrays.

    Columns of docs that share a name with out are not carried along unless kept; repeated rows give repeated rows.
    """
    source = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    # Each kind is a column first: what reads it twice then doesn't compute it twice.
    source = source.select(*keep, *[spans_of(k, F.col("__text")).alias(f"__{k}") for k in KINDS])
    return source.select(*keep, F.struct(*[F.col(f"__{k}").alias(k) for k in KINDS]).alias(out))


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""
    texts = [F.transform(found[k], lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds]
    return F.array_join(F.concat(*texts), ",")


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans become one, named after the first. Null texts stay null.

    chars_col, if docs has it, is set to the new length of the texts that changed.
    """
    text, names = F.col(text_col), docs.columns
    found = F.struct(*[spans_of(k, F.coalesce(text, F.lit(""))).alias(k) for k in KINDS])
    spans = F.array_sort(F.transform(F.concat(*[F.col("__pii")[k] for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).alias("from"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))
    kind = "array<struct<from:int,start:int,end:int,kind:string>>"

    def merge(done: Column, s: Column) -> Column:
        last, end = F.coalesce(F.try_element_at(done, F.lit(-1)), empty), -s["end"]
        inside = (F.size(done) > 0) & (s["start"] < last["end"])
        wider = F.struct(last["from"].alias("from"), last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind"))
        fresh = F.struct(last["end"].alias("from"), s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
        return F.when(inside, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(fresh))).cast(kind)

    merged = F.aggregate(spans, F.array().cast(kind), merge)
    parts = F.transform(F.col("__merged"), lambda m: F.concat(F.substring(text, m["from"] + 1, m["start"] - m["from"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    rest = F.substr(text, F.try_element_at(F.col("__merged"), F.lit(-1))["end"] + 1)
    changed = F.size("__merged") > 0
    out = docs.withColumn("__pii", found).withColumn("__merged", merged).withColumn("__text", F.when(changed, F.concat(F.array_join(parts, ""), rest)).otherwise(text))
    made = [F.col("__text").alias(c) if c == text_col else F.when(changed, F.length("__text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == chars_col else F.col(f"`{c}`") for c in names]
    return out.select(*made)


#: For DuckDB: the same spans from the plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def sql(table: str = "documents") -> str:
    """The digest query as DuckDB SQL."""
    each = " UNION ALL ".join(f"SELECT doc_id, text, {n} AS rank, '{k}' AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM docs" for n, (k, p) in enumerate(PLAIN.items()))
    lengths = ", ".join(f"'{c}{n}'" for c, n in IBAN_LENGTHS.items())
    words = " ".join(f"WHEN '{k}' THEN '(?:^|[^a-z])(?:{w})'" for k, w in CONTEXT_WORDS.items())
    scores = " ".join(f"WHEN '{k}' THEN {s}" for k, s in SCORES.items())
    ip = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE s.kind = '{k}'), 0) AS n_{k}" for k in BASE_KINDS)
    span = "string_agg(s.kind || ':' || s.b || ':' || s.e, ',' ORDER BY s.rank, s.b)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {table}),
raw AS (SELECT * FROM ({each.replace("doc_id, text,", "rid, text,")})),
nth AS (SELECT rid, text, rank, kind, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM raw),
placed AS (SELECT rid, text, rank, kind, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS b FROM nth),
more AS (SELECT *, b + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c FROM placed),
seen AS (SELECT *, lower(text[greatest(b - {CONTEXT}, 0) + 1 : b] || ' ' || text[e + 1 : e + {CONTEXT}]) AS around, c[5:] || c[1:4] AS turned FROM more),
ok AS (SELECT * FROM seen WHERE CASE kind
  WHEN 'ip' THEN regexp_full_match(m, '{ip}(?:\\.{ip}){{3}}')
  WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT ELSE (2 * d[-i]::INT) // 10 + (2 * d[-i]::INT) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
  WHEN 'iban' THEN (c[1:2] || length(c)) IN ({lengths}) AND list_reduce(list_transform(range(1, length(turned) + 1), lambda i: ascii(turned[i])::BIGINT), lambda r, x: CASE WHEN x < 58 THEN (r * 10 + x - 48) % 97 ELSE (r * 100 + x - 55) % 97 END, 0::BIGINT) = 1
  ELSE true END
  AND (rank < {len(BASE_KINDS)} OR CASE kind {scores} END + CASE WHEN regexp_matches(around, CASE kind {words} END) THEN {BONUS} ELSE 0 END >= {LEAST}))
SELECT docs.doc_id, {counts}, sha256(coalesce({span[:-1]}) FILTER (WHERE s.rank < {len(BASE_KINDS)}), '')) AS base_sha256, coalesce({span}, '') AS spans
FROM docs LEFT JOIN ok s ON docs.rid = s.rid GROUP BY docs.rid, docs.doc_id"""
