"""Numpy over the bytes of many texts at once: words, their hashes, and hashes of word runs.

Texts arrive as Arrow columns; a block is one uint8 array plus offsets, so no Python loop runs per word.
All non-ASCII characters consist of bytes of 128 and more, so classes of ASCII characters can be judged byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
#: Bytes that are handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE, _INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Of lower-cased bytes: digits, letters, and all that isn't ASCII.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
#: All but the ASCII blanks.
DARK_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most so many bytes, or of one row. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each text and the number of runs) of maximal runs of wanted bytes, which never cross texts."""
    inside = wanted[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _folding() -> np.ndarray:
    """The simple case folding of each character that has one of the same length; all others are their own."""
    table = np.arange(0x1E944, dtype=np.uint32)
    for k in range(0x1E944):
        if len(low := chr(k).casefold()) == 1:
            table[k] = ord(low)
    return table


def characters(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(characters, offsets counted in characters) of a block of UTF-8 texts, case-folded if wanted."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        chars = data.astype(np.uint32)
    else:
        near = np.zeros(len(data) + 3, np.uint32)
        near[: len(data)] = data
        chars = near[lead]
        for low, high, more, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            at = np.flatnonzero((chars >= low) & (chars < high) & (data[lead] >= low))
            code = chars[at] & bits
            for j in range(1, more + 1):
                code = code << np.uint32(6) | near[lead[at] + j] & 0x3F
            chars[at] = code
    if fold:
        if "fold" not in _POWERS:
            _POWERS["fold"] = _folding()
        known = np.flatnonzero(chars < len(_POWERS["fold"])) if len(lead) < len(data) else slice(None)
        chars[known] = _POWERS["fold"][chars[known]]
    return chars, np.searchsorted(lead, offsets)


def character_grams(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, of 2**bits, of each n consecutive characters; one for each place."""
    size = len(chars) - n + 1
    if size <= 0:
        return np.zeros(0, np.int32)
    code = chars[:size] + np.uint32(n)
    for j in range(1, n):
        code = code * np.uint32(0x01000193) + chars[j : j + size]
    code = code * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - bits)).astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, BLOCK_BYTES + 1), base, U64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, alike wherever the run stands."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        part = data[base : ends[end - 1]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = end
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive items; one fewer than k are none. Runs over the ends of texts are the caller's to skip."""
    if len(words) < k:
        return np.zeros(0, U64)
    n, total, factor = len(words) - k + 1, None, 1
    for j in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
        term = words[j : j + n] * U64(factor)
        total = term if total is None else total + term
    return mix(total)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive items, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small values and slow changes cost little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()
