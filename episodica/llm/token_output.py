"""Token ids in binary files: independent zstandard frames with a trailing seek table and per-frame checksums.

File format (the public zstandard seekable format with one more skippable frame; all integers little-endian):
  data frames        zstandard, each of at most FRAME_IDS ids as unsigned 32-bit integers
  document index     skippable frame 0x184D2A5D: documents as int64, then for each document its id (int64; the least
                     value stands for null) and the number of ids before it in the file (int64), then all ids (int64)
  seek table         skippable frame 0x184D2A5E: for each data frame its compressed and decompressed size and the low
                     half of the XXH64 of its content (3 x uint32), then frames (uint32), descriptor 0x80, 0x8F92EAB1
A reader that wants one document reads the two tables at the end and then only the frames that hold its ids.

Files are written by tasks under a name that only the partition decides, first under a name of the attempt and then
renamed: a repeated task replaces equal content by equal content.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import Scratch, partitions, prepare
from .spans import LOWER
from .token_counts import tokenizer

FRAME_IDS = 1 << 16
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
#: Pieces whose ids a worker keeps, in each of two generations.
KEPT_PIECES = 300_000
_LOWER = LOWER.tobytes()
_ENCODERS: dict[str, Encoder] = {}
#: The tokenizer's pattern on dark ASCII bytes and Latin-1 letters, without capitals; a tail of punctuation that no match shares with the letter before.
_PLAIN = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^a-z0-9\xc3]+")
_TAIL = re.compile(rb"(?<=[a-z])[.,!?;:|]+$|(?<=\xc3[\x9f-\xb6\xb8-\xbf])[.,!?;:|]+$")
#: The byte alphabet: printable Latin-1 bytes are their own characters, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def by_words(path: str) -> bool:
    """Whether each run of dark characters is encoded on its own, and case doesn't matter: read from the file itself."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and split.get("type") == "Split"
        and split["behavior"] == "Removed"
        and split["invert"]
        and [x["type"] for x in made["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"]
        and re.fullmatch(r"(?:'[a-z]+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\|\[\^\\s\\p\{L\}\\p\{N\}\]\+", split["pattern"]["Regex"]) is not None
        and not any(re.search(r"\s", x["content"]) for x in made.get("added_tokens", []))
    )


class Pieces(dict):
    """Ids of pieces, made when first asked for. A full generation becomes the older one, from which what is still in use returns."""

    def __init__(self, make, most: int = KEPT_PIECES):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes. Where the tokenizer works by words, the ids of each piece are kept.

    Only ASCII capitals are lowered beforehand, and not in texts with combining marks (their composition may differ by
    case) or with what may be an added token. Pieces of lower-cased printable ASCII and Latin-1 letters are cut by the
    pattern here and each part goes to the model alone, as normalizing doesn't change them; all others go to the library.
    """

    def __init__(self, path: str):
        self.coder, self.words = tokenizer(path), by_words(path)
        if self.words:
            self.model = self.coder.model
            self.packed = [struct.pack("<I", i) for i in range(max(self.coder.get_vocab().values()) + 1)]
            self.kept = Pieces(self.piece)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 2048) for e in self.coder.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)]

    def piece(self, piece: bytes) -> bytes:
        packed = self.packed
        if piece.isalpha() and piece.islower():
            return b"".join([packed[t.id] for t in self.model.tokenize(piece.decode())])
        core = piece.rstrip(b".,!?;:|")
        if len(core) < len(piece) and core.isalpha() and core.islower():
            return self.kept[core] + self.kept[piece[len(core) :]]
        if _PLAIN.fullmatch(piece) and b"<|" not in piece:
            parts = _PARTS.findall(piece)
            if len(parts) > 1:
                return b"".join([self.kept[x] for x in parts])
            return b"".join([packed[t.id] for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))])
        if tail := _TAIL.search(piece):
            return self.kept[piece[: tail.start()]] + self.kept[tail.group()]
        return b"".join([packed[i] for i in self.coder.encode(piece.decode(), add_special_tokens=False).ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return self.library(texts)
        out, get = [], self.kept.__getitem__
        for text in texts:
            raw = text.encode()
            if not (b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw):
                raw = raw.translate(_LOWER)
            out.append(b"".join(map(get, raw.split())))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


class Writer:
    """Writes one file; documents come in the order in which they are to stand."""

    def __init__(self, out):
        import zstandard

        self.out, self.pending, self.size = out, [], 0
        self.press = zstandard.ZstdCompressor(level=1)
        self.seek, self.ids, self.before, self.total = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.before.append(self.total)
        self.total += len(ids) // 4
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            data = b"".join(self.pending)
            whole = len(data) // (4 * FRAME_IDS) * 4 * FRAME_IDS
            for at in range(0, whole, 4 * FRAME_IDS):
                self.frame(data[at : at + 4 * FRAME_IDS])
            self.pending, self.size = [data[whole:]], len(data) - whole

    def frame(self, data: bytes) -> None:
        import xxhash

        pressed = self.press.compress(data)
        self.out.write(pressed)
        self.seek.append((len(pressed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> int:
        if self.size:
            self.frame(b"".join(self.pending))
        index = struct.pack("<q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.before, "<i8").tobytes() + struct.pack("<q", self.total)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        return self.total


class Reader:
    """Reads one file: its tables first, then only the frames that are asked for. Every frame is held against its checksum."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table")
        table = size - 9 - 12 * frames
        kind, length = struct.unpack("<II", self.at(table - 8, 8))
        if (kind, length) != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("broken seek table")
        seek = np.frombuffer(self.at(table, 12 * frames), "<u4").reshape(-1, 3)
        self.packed, self.sums = seek[:, 0].astype(np.int64), seek[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        self.first = np.concatenate([[0], np.cumsum(seek[:, 1].astype(np.int64))]) // 4
        index = self.at(int(self.starts[-1]), table - 8 - int(self.starts[-1]))
        kind, length = struct.unpack("<II", index[:8])
        n = struct.unpack("<q", index[8:16])[0]
        if (kind, length) != (INDEX_MAGIC, 16 * n + 16):
            raise ValueError("broken document index")
        self.ids = np.frombuffer(index, "<i8", n, 16)
        self.before = np.frombuffer(index, "<i8", n + 1, 16 + 8 * n)

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self.at(int(self.starts[k]), int(self.packed[k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.sums[k]):
            raise ValueError(f"frame {k} is damaged")
        return data

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frames are decompressed."""
        low, high = int(self.before[k]), int(self.before[k + 1])
        a = max(0, int(np.searchsorted(self.first, low, "right")) - 1)
        parts, at = [], a
        while at < len(self.packed) and int(self.first[at]) < high:
            parts.append(self.frame(at))
            at += 1
        data, base = b"".join(parts), int(self.first[a]) if len(self.packed) else 0
        return np.frombuffer(data[4 * (low - base) : 4 * (high - base)], "<u4")

    def documents(self):
        """All documents in order: (number, ids as bytes). Each frame is read once."""
        data, base, at = b"", 0, 0
        for k in range(len(self.ids)):
            low, high = 4 * int(self.before[k]), 4 * int(self.before[k + 1])
            if high - base > len(data):
                parts, have = [data[low - base :]], len(data) - (low - base)
                base = low
                while have < high - low:
                    parts.append(self.frame(at))
                    have += len(parts[-1])
                    at += 1
                data = b"".join(parts)
            yield k, data[low - base : high - base]


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write files in ascending id order (nulls first; equal ids by text): part, file, n_docs, n_tokens.

    Null texts are empty. end_id, if any, follows each document. The rows must be materialised before files are read.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ordered = source.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        context = TaskContext.get()
        part, coder, writer, out, n = context.partitionId(), encoder(path), None, None, 0
        store, base = filesystem(folder)
        name = f"{base}/part-{part:06d}.tokens"
        temp = f"{name}.{context.taskAttemptId()}"
        for batch in batches:
            if writer is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(temp)
                writer = Writer(out)
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 200):
                for doc_id, data in zip(ids[at : at + 200], coder.encode([x or "" for x in texts[at : at + 200].to_pylist()]), strict=True):
                    writer.add(doc_id, data + end)
                    n += 1
        if writer is not None:
            total = writer.close()
            out.close()
            store.move(temp, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{os.path.basename(name)}"], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long")


def read_digests(files: DataFrame) -> DataFrame:
    """Every document of the files, read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = prepare(files.sparkSession)
    earlier = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, at = filesystem(name)
                with store.open_input_file(at) as file:
                    reader = Reader(file)
                    sums = np.fromiter((zlib.crc32(data) for _, data in reader.documents()), np.int64, len(reader.ids))
                ids = pa.array(reader.ids, mask=reader.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(reader.before[:-1] + first), pa.array(np.diff(reader.before)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a file; the window orders these few rows only.
    return files.select("file", earlier.cast("long").alias("first")).repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int | None, **columns) -> tuple[DataFrame, Scratch]:
    """Files in the shared folder and their written list."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return scratch.table(write_tokens(docs, path, f"{scratch.path}/files", end_id, **columns)), scratch
