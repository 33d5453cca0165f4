"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, letters and non-ASCII characters. Of each text the least hash of every window of
WINDOW consecutive GRAM-word hashes is kept, as far as it isn't that of the window before. Texts that share a span of
SPAN = WINDOW + GRAM - 1 words share all its windows, so at least one fingerprint: every shared span is found. A hit is
extended to the spans around it, and each is held against the benchmark's own words. Items shorter than SPAN are one
window each, fingerprinted whole at every place (a window of one hash).

The benchmark is joined in blocks of at most BLOCK_BYTES of text (an item that is longer is a block of its own), each
broadcast to the documents: one block for usual benchmarks, several passes for huge ones. Documents are never shuffled
for one block, and a hot passage or source costs no more than its own words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .spans import LOWER, WORD_BYTES, blocks, gram_hashes, hash_runs, runs, window_min

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Text of the benchmark that one broadcast holds.
BLOCK_BYTES = 4 << 20


def words_of(texts: pa.Array):
    """For each block of rows: first row, lower-cased bytes, starts, ends and first word of each row, hashes."""
    for at, end, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, ends, first = runs(data, offsets, WORD_BYTES)
        yield at, end, data, starts, ends, first, hash_runs(data, starts, ends)


def sampled(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the winnowed k-gram hashes; of equal minima in a window each counts. Texts shorter than a window give none."""
    grams = gram_hashes(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64)
    size = k + w - 1
    lengths = np.diff(first)
    allowed = np.zeros(len(hashes) + 1, np.int64)  # window starts inside one text
    long = lengths >= size
    np.add.at(allowed, first[:-1][long], 1)
    np.add.at(allowed, first[1:][long] - size + 1, -1)
    allowed = np.cumsum(allowed[:-1]) > 0
    if len(grams) < w:
        return np.zeros(0, np.int64)
    least = window_min(grams, w)
    allowed = allowed[: len(least)]
    chosen = np.zeros(len(grams), bool)
    for j in range(w):
        chosen[j : j + len(least)] |= allowed & (grams[j : j + len(least)] == least)
    return np.flatnonzero(chosen)


class Index:
    """One block of the benchmark: fingerprints by hash, and every window's words with the items that hold it."""

    def __init__(self, items: list[tuple]):
        self.ids = sorted({i for i, _ in items}, key=str)
        number = {i: n for n, i in enumerate(self.ids)}
        windows: dict[bytes, set] = defaultdict(set)
        prints: dict[int, list] = defaultdict(list)
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        for at, _, data, starts, ends, first, hashes in words_of(texts):
            raw = data.tobytes()
            chosen = sampled(hashes, first, GRAM, WINDOW)
            prints[SPAN].append(gram_hashes(hashes, GRAM)[chosen])
            for row in range(len(first) - 1):
                a, b = int(first[row]), int(first[row + 1])
                if a == b:
                    continue
                words = [raw[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                size = min(SPAN, len(words))
                for s in range(len(words) - size + 1):
                    windows[b" ".join(words[s : s + size])].add(number[items[at + row][0]])
                if size < SPAN:
                    prints[size].append(gram_hashes(hashes[a:b], size))
        self.windows = {k: tuple(sorted(v)) for k, v in windows.items()}
        self.prints = {size: np.unique(np.concatenate(x)) for size, x in sorted(prints.items())}

    def scan(self, texts: pa.Array):
        """For each row: (number of words, runs of hit words, numbers of items with occurring windows)."""
        for _, _, data, starts, ends, first, hashes in words_of(texts):
            todo: dict[int, list] = defaultdict(list)
            for size, known in self.prints.items():
                if not len(known):
                    continue
                k, w = (GRAM, WINDOW) if size == SPAN else (size, 1)
                places = sampled(hashes, first, k, w)
                grams = gram_hashes(hashes, k)[places] if len(places) else np.zeros(0, np.uint64)
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hits = places[known[at] == grams]
                if not len(hits):
                    continue
                spans = np.unique((hits[:, None] - np.arange(w)[None, :]).ravel())
                rows = np.searchsorted(first, spans, "right") - 1
                inside = (spans >= 0) & (rows >= 0)
                spans, rows = spans[inside], rows[inside]
                inside = spans + size <= first[rows + 1]
                for row, s in zip(rows[inside].tolist(), spans[inside].tolist(), strict=True):
                    todo[row].append((s, size))
            for row in range(len(first) - 1):
                a, b = int(first[row]), int(first[row + 1])
                hit, items = [], set()
                if row in todo:
                    raw = data[starts[a] : ends[b - 1]].tobytes()
                    base = int(starts[a])
                    words = [raw[s - base : e - base] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    for s, size in sorted(todo[row]):
                        s -= a
                        found = self.windows.get(b" ".join(words[s : s + size]))
                        if found:
                            items.update(found)
                            if hit and s <= hit[-1][1]:
                                hit[-1][1] = max(hit[-1][1], s + size)
                            else:
                                hit.append([s, s + size])
                yield b - a, hit, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> list[DataFrame]:
    """The benchmark in parts whose text has about most bytes each, by a hash of the id."""
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-total // most)
    if n <= 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """One row a document: carry (id_col alone by default), n_words, n_hit, hit_spans (word numbers, ends exclusive), item_ids (those found, as strings in their order).

    A null text has no words. An item without words has no window, an empty benchmark no hit. Items that repeat count
    once by id. With several blocks of items, documents are told apart by id and text; equal rows give equal rows.
    """
    spark = prepare(docs.sparkSession)
    carry = (id_col,) if carry is None else carry
    parts = item_blocks(benchmark.select(item_col, item_text_col), item_col, item_text_col, block_bytes)
    single = len(parts) == 1
    along = carry if single else (id_col,)
    source = docs.select(*[docs[c] for c in along], docs[text_col].alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in along) + ", n_words long, hit_spans array<array<long>>, item_ids array<string>" + ", row_key string" * (not single)

    def scan(part: DataFrame) -> DataFrame:
        known = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()]))  # at most one block of items

        def run(batches):
            index = known.value
            names = np.array([str(i) for i in index.ids], object)
            for batch in batches:
                n, hits, items = [], [], []
                for words, hit, found in index.scan(batch.column("__text")):
                    n.append(words)
                    hits.append(hit)
                    items.append(sorted({names[x] for x in found}))
                columns = {**{c: batch.column(c) for c in along}, "n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(hits, pa.list_(pa.list_(pa.int64()))), "item_ids": pa.array(items, pa.list_(pa.string()))}
                if not single:
                    columns["row_key"] = pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in batch.column("__text").to_pylist()])
                yield pa.RecordBatch.from_pydict(columns)

        return source.mapInArrow(run, schema)

    if single:
        found = scan(parts[0])
    else:
        every = reduce(DataFrame.unionByName, (scan(p) for p in parts))
        grouped = every.groupBy(id_col, "row_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hit_spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
        join = lambda done, s: F.when((F.size(done) > 0) & (s[0] <= F.coalesce(F.try_element_at(done, F.lit(-1))[1], F.lit(-1))), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(F.try_element_at(done, F.lit(-1))[0], F.greatest(F.try_element_at(done, F.lit(-1))[1], s[1]))))).otherwise(F.array_append(done, s))
        found = grouped.select(id_col, "row_key", "n_words", F.aggregate(F.array_sort("all"), F.array().cast("array<array<long>>"), join).alias("hit_spans"), "item_ids").withColumnRenamed(id_col, "__id")
        rows = docs.select(*carry, docs[id_col].alias("__own"), F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256).alias("row_key"))
        found = rows.join(found, ["row_key"]).where(F.col("__own").eqNullSafe(F.col("__id")))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(*carry, "n_words", n_hit.alias("n_hit"), "hit_spans", "item_ids")


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


#: For DuckDB: all windows of the benchmark against all windows of the documents.
SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT *, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT rid, size, i, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT w.*, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM k) WHERE len(ws) >= size)),
h AS (SELECT rid, i, d.size, item_id FROM d JOIN k ON d.size = k.size AND d.g = k.g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
