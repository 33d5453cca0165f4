"""Media columns: payloads stored as FLAC, read back, and written as PCM blocks with seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flac
from .runtime import prepare

#: Payload bytes that are coded side by side, and samples of a PCM block.
GROUP_BYTES, BLOCK_SAMPLES = 1 << 20, 1 << 14


def payload(text: str | None) -> bytes:
    """UTF-8, with spaces up to a positive multiple of a frame. Null is empty."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % flac.FRAME if raw else flac.FRAME)


def groups(items: list[bytes], most: int = GROUP_BYTES):
    """(first, end) of runs of items of at most so many bytes together, or of one item."""
    at, size = 0, 0
    for k, item in enumerate(items):
        if k > at and size + len(item) > most:
            yield at, k
            at, size = k, 0
        size += len(item)
    if items:
        yield at, len(items)


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_bytes of its text, media (a FLAC stream of its padded bytes as 8-bit samples)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            stored = [payload(t) for t in texts]
            streams = [s for a, b in groups(stored) for s in flac.encode(stored[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(streams, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Length, sum, energy, extremes and crossings of the samples' middle, from whole numbers only."""
    n, total = len(samples), int(samples.sum())
    above = samples * n > total
    return f"n={n};sum={total};energy={int((samples * samples).sum())};min={int(samples.min(initial=0))};max={int(samples.max(initial=0))};cross={int((above[1:] != above[:-1]).sum())}"


def cut_pcm(samples: np.ndarray, block: int) -> list[tuple[int, bytes, int]]:
    """(sample offset, signed bytes, crc32) of each PCM block."""
    pcm = [samples[s : s + block].astype(np.int8).tobytes() for s in range(0, len(samples), block)]
    return [(k * block, x, zlib.crc32(x)) for k, x in enumerate(pcm)]


def join_pcm(blocks: list[tuple[int, bytes, int]]) -> np.ndarray:
    """The samples of blocks in order; a gap or a block that doesn't fit its checksum fails."""
    at = 0
    for offset, pcm, crc in blocks:
        if offset != at or zlib.crc32(pcm) != crc:
            raise ValueError(f"PCM block at sample {offset} is damaged or out of place")
        at += len(pcm)
    return np.frombuffer(b"".join(pcm for _, pcm, _ in blocks), np.int8).astype(np.int64)


def read_media(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """Decode streams to PCM blocks and digest what those hold: one row a stream, with its checked samples' features.

    Columns: id_col, carry, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256,
    feature. A null stream gives nulls; a damaged one fails the job, since its content can't be known.
    """
    prepare(media.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in media.schema}
    head = ", ".join(f"`{c}` {types[c]}" for c in (id_col, *carry))

    def run(batches):
        for batch in batches:
            streams = batch.column(media_col).to_pylist()
            rows: list = [(None,) * 6] * len(streams)
            live = [k for k, s in enumerate(streams) if s is not None]
            for a, b in groups([streams[k] for k in live]):
                for k, samples in zip(live[a:b], flac.decode([streams[k] for k in live[a:b]]), strict=True):
                    samples = join_pcm(cut_pcm(samples, BLOCK_SAMPLES))
                    raw = (samples + 128).astype(np.uint8).tobytes()
                    rows[k] = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(streams[k]), hashlib.sha256(streams[k]).hexdigest(), feature(samples))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (id_col, *carry)] + columns, [id_col, *carry, *names])

    return media.select(id_col, *carry, media_col).mapInArrow(run, head + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", block: int = BLOCK_SAMPLES) -> DataFrame:
    """PCM blocks of the streams: id_col, block_no, sample_offset, n_samples, pcm (signed bytes), crc32. Null streams give none."""
    prepare(media.sparkSession)
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, streams = batch.column(id_col).to_pylist(), batch.column(media_col).to_pylist()
            for doc_id, stream in zip(ids, streams, strict=True):
                if stream is None:
                    continue
                cut = cut_pcm(flac.decode([stream])[0], block)
                starts, pcm, crcs = ([c[j] for c in cut] for j in range(3))
                made = {id_col: [doc_id] * len(cut), "block_no": list(range(len(cut))), "sample_offset": starts, "n_samples": [len(x) for x in pcm], "pcm": pcm, "crc32": crcs}
                yield pa.RecordBatch.from_arrays([pa.array(made[id_col], batch.schema.field(id_col).type), *(pa.array(made[c], pa.int64()) for c in ("block_no", "sample_offset", "n_samples")), pa.array(pcm, pa.binary()), pa.array(made["crc32"], pa.int64())], list(made))

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, block_no long, sample_offset long, n_samples long, pcm binary, crc32 long")
