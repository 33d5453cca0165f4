"""Token counts of whole texts, equal to one call of the tokenizers library on each.

A text of more than one chunk is encoded by the library in overlapping chunks with offsets: two chunks are spliced at
an offset inside their overlap where both have a token boundary and the text has a stable boundary (white space after
anything else: the byte-level pattern never matches across, and no added token holds a blank); if no such offset
exists, the overlap is widened, and then the chunk is doubled, up to the rest of the text. A text of one chunk is cut at its
stable boundaries alone, and the library's count of each piece is kept, as most pieces recur.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare

#: The characters of a chunk, and of the first overlap.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 256
#: Pieces whose counts are kept by a worker. Beyond, pieces are counted without being kept.
KEPT_PIECES = 400_000
_STABLE = re.compile(r"(?<=\S)(?=[ \n])")
_BLANKS = re.compile(r"\s[ \n]")
_TOKENIZERS: dict = {}
_COUNTS: dict[str, dict[str, int]] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def stable_pieces(text: str) -> list[str]:
    """The text cut at its stable boundaries; joined, the pieces are the text."""
    if "\0" in text or _BLANKS.search(text):
        return _STABLE.split(text)
    out = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return out[1:] if not out[0] else out


def splice(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The last offset in [low, high] that starts a token in both chunks and is a stable boundary of the text."""
    for at in sorted(set(left).intersection(right), reverse=True):
        if low < at <= high and text[at] in " \n" and not text[at - 1].isspace():
            return at
    return None


def count_huge(text: str, coder, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens by overlapping chunks. Offsets count characters of the whole text."""
    total, at, size = 0, 0, overlap
    end = min(len(text), chunk)
    starts = [a for a, _ in coder.encode(text[at:end], add_special_tokens=False).offsets]
    while end < len(text):
        low = max(at, end - size)
        after = min(len(text), end + (chunk if end - at <= chunk else end - at))
        nexts = [low + a for a, _ in coder.encode(text[low:after], add_special_tokens=False).offsets]
        cut = splice(text, starts, nexts, low, end - 1)
        if cut is None:
            if low > at:
                size *= 2  # a wider overlap
                continue
            end = after  # the overlap is the whole chunk: take twice the text as one chunk
            starts = nexts
            continue
        total += int(np.searchsorted(starts, cut))
        starts, at, end, size = nexts[int(np.searchsorted(nexts, cut)) :], cut, after, overlap
    return total + len(starts)


class Counter:
    """Counts texts with one tokenizer, keeping the counts of pieces."""

    def __init__(self, path: str):
        self.coder, self.kept = tokenizer(path), _COUNTS.setdefault(path, {})

    def counts(self, texts: list[str]) -> list[int]:
        kept, cut, new = self.kept, [], {}
        for text in texts:
            cut.append(None if len(text) > CHUNK_CHARS else stable_pieces(text))
            if cut[-1]:
                for piece in cut[-1]:
                    if piece not in kept:
                        new[piece] = 0
        if new:
            keys = list(new)
            for at in range(0, len(keys), 4096):
                part = keys[at : at + 4096]
                new.update(zip(part, map(len, self.coder.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            if len(kept) + len(new) <= KEPT_PIECES:
                kept.update(new)
                new = kept
            else:
                new = {**new, **{p: kept[p] for pieces in cut if pieces for p in pieces if p in kept}}
        else:
            new = kept
        get = new.__getitem__
        return [count_huge(text, self.coder) if pieces is None else sum(map(get, pieces)) for text, pieces in zip(texts, cut, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_bytes of its UTF-8, n_tokens, over_limit (more than limit tokens).

    Null texts count as empty (0, 0, false). Special strings inside texts are handled as the library's default does
    it; begin and end tokens aren't added. Other columns of docs don't matter; repeated rows give repeated rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = np.array([m for at in range(0, len(texts), 200) for m in counter.counts(texts[at : at + 200])], np.int64)
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
