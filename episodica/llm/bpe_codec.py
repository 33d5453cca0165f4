"""Byte-level BPE encoding and decoding with a local rank file.

Each match of the pre-splitting pattern is encoded on its own, without special tokens, as the tiktoken library does it.
Long texts are cut beforehand, only where the pattern can't match across: before white space that follows anything
else, and between a letter and a digit. The pattern looks ahead past a match only from white space, so neither side of
such a cut changes how the other is matched. A text without such places stays whole.

Null texts are empty ones: no tokens. Ids decode to the very bytes of the text, checked by the caller's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare

#: Characters after which the next safe place is looked for.
PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The encoder of a rank file; kept, as loading takes a second."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe places, each the first one after so many characters."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if found is None or found.start() >= len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(text: str, coder, most: int = PIECE_CHARS) -> list[int]:
    if len(text) <= most:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text, most) for i in coder.encode_ordinary(piece)]


def encode_decode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_bytes: bool = True) -> DataFrame:
    """One row a document: its id, the ids of its text, and the bytes that they decode to.

    Columns: id_col, token_ids (array<int>, if with_ids), n_tokens, ids_sha256 of the ids as little-endian unsigned
    32-bit integers, decoded (binary, if with_bytes), decoded_sha256. Other columns of docs don't matter. An empty
    table gives an empty result, repeated rows give repeated rows, a null id stays null.
    """
    prepare(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded binary" * with_bytes

    def run(batches):
        coder = encoding(path, pattern)
        for batch in batches:
            rows = {"n": [], "ids": [], "out": [], "kept": [], "bytes": []}
            for text in batch.column("text"):
                ids = encode(text.as_py() or "", coder)
                raw, decoded = np.array(ids, "<u4"), coder.decode_bytes(ids)
                rows["n"].append(len(ids))
                rows["ids"].append(hashlib.sha256(raw).hexdigest())
                rows["out"].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    rows["kept"].append(raw.astype(np.int32))
                if with_bytes:
                    rows["bytes"].append(decoded)
            columns = [batch.column("id"), pa.array(rows["n"], pa.int64()), pa.array(rows["ids"], pa.string()), pa.array(rows["out"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(rows["kept"], pa.list_(pa.int32())))
                names.append("token_ids")
            if with_bytes:
                columns.append(pa.array(rows["bytes"], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)
