"""FLAC streams of one channel of 8-bit samples, many frames at a time in numpy.

The encoder cuts a signal into frames of 192 samples and gives each the cheapest of: a constant, plain samples, a fixed
predictor of order 0 or 1, or a linear predictor of order 1, with Rice-coded residuals. Metadata: STREAMINFO with the
MD5 of the samples, an APPLICATION block "epix" with the size of every frame (uint16, big-endian), and a SEEKTABLE
with a point each SEEK_FRAMES frames. All frames of all streams of a batch are decoded side by side, one lane a frame.
Streams without the index are decoded frame after frame. The decoder takes any predictor order, both Rice methods,
partitions, escape codes and block sizes; it rejects several channels, wasted bits and a wrong checksum or digest.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

FRAME, SEEK_FRAMES, RATE = 192, 32, 8000
INDEX_ID = b"epix"
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
_LPC_BITS = 7


def _table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The checksum of each stretch of bytes, all of them in step."""
    table, out = (CRC8, np.zeros(len(starts), np.int64)) if width == 8 else (CRC16, np.zeros(len(starts), np.int64))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, (int(lengths[0]) if len(lengths) else 0) + 1), "right")
    for i, n in enumerate(live):
        byte = data[starts[:n] + i]
        out[:n] = table[out[:n] ^ byte] if width == 8 else (out[:n] << 8 & 0xFFFF) ^ table[out[:n] >> 8 ^ byte]
    back = np.empty_like(out)
    back[order] = out
    return back


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 way: (bytes as a matrix of 6 columns, lengths)."""
    lengths = 1 + (values >= 0x80) + (values >= 0x800) + (values >= 0x10000) + (values >= 0x200000) + (values >= 0x4000000)
    out = np.zeros((len(values), 6), np.uint8)
    for n in range(1, 7):
        rows = lengths == n
        v = values[rows]
        if not len(v):
            continue
        out[rows, 0] = v if n == 1 else (0xFF << (8 - n) & 0xFF) | v >> 6 * (n - 1)
        for j in range(1, n):
            out[np.flatnonzero(rows), j] = 0x80 | v >> 6 * (n - 1 - j) & 0x3F
    return out, lengths


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the better of two likely Rice parameters for each frame, and the bits that it takes."""
    folded = ((residual << 1) ^ (residual >> 31)).astype(np.int16)
    n = folded.shape[1]
    mean = folded.sum(1) / max(n, 1)
    low = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 13).astype(np.int32)
    cost = [n * (1 + k) + (folded >> k[:, None].astype(np.int16)).sum(1, dtype=np.int32) for k in (low, low + 1)]
    better = cost[1] < cost[0]
    return folded, low + better, np.where(better, cost[1], cost[0])


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of FRAME samples (-128 to 127) and their frame numbers: (all frames' bytes, their sizes)."""
    x = samples.astype(np.int32)
    count = len(x)
    tries = {}
    for order in (0, 1):
        tries["fixed", order] = (*_rice(np.diff(x, order, axis=1) if order else x), 8 * order)
    a, b = x[:, :-1], x[:, 1:]
    energy = np.maximum((a.astype(np.int64) ** 2).sum(1), 1)
    factor = np.clip(np.rint(32 * (a.astype(np.int64) * b).sum(1) / energy), -64, 63).astype(np.int32)
    tries["lpc", 1] = (*_rice(b - (factor[:, None] * a >> 5)), 8 + 16)
    names = list(tries)
    bits = np.stack([8 + tries[k][3] + 10 + tries[k][2] for k in names] + [np.full(count, 8 + 8 * FRAME)])
    pick = bits.argmin(0)
    pick[(x == x[:, :1]).all(1)] = len(names) + 1
    bits = np.vstack([bits, np.full(count, 16)])[pick, np.arange(count)]

    number, number_size = _numbers(numbers)
    head = 5 + number_size  # with the CRC-8
    sizes = head + (bits + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out, after = np.zeros(int(starts[-1]), np.uint8), starts[:-1] + head
    for n, name in enumerate(names):
        rows = np.flatnonzero(pick == n)
        if not len(rows):
            continue
        folded, ks, _, warm = tries[name]
        at = after[rows] + 1 + warm // 8
        k, u = ks[rows].astype(np.int64)[:, None], folded[rows].astype(np.int64)
        ends = np.cumsum((u >> k) + k + 1, 1) + (8 * at + 10)[:, None]
        stop = ends - k - 1
        code = (u & (1 << k) - 1 | 1 << k) << (23 - k - (stop & 7))
        first = int(at[0])
        byte, width = (stop >> 3).ravel() - first, int(starts[rows[-1] + 1]) - first + 3
        code, made = code.ravel(), np.zeros(width)
        for j in range(3 if int(k.max()) > 1 else 2):
            made += np.bincount(byte + j, code >> (16 - 8 * j) & 0xFF, width)
        out[first : first + width - 3] |= made[: width - 3].astype(np.uint8)
        out[at] |= (k[:, 0] >> 2).astype(np.uint8)
        out[at + 1] |= (k[:, 0] << 6 & 0xFF).astype(np.uint8)
    for j, value in enumerate((0xFF, 0xF8, 0x10, 0x02)):
        out[starts[:-1] + j] = value
    for j in range(6):
        rows = number_size > j
        out[starts[:-1][rows] + 4 + j] = number[rows, j]
    out[after - 1] = crc(out, starts[:-1], head - 1, 8)
    kinds = np.array([0x10, 0x12, 0x40, 0x02, 0x00], np.uint8)  # fixed 0 and 1, linear 1, plain, constant
    out[after] = kinds[pick]
    plain = (samples.astype(np.int16) & 0xFF).astype(np.uint8)
    for n, warm in ((1, 1), (2, 1), (4, 1), (3, FRAME)):
        rows = np.flatnonzero(pick == n)
        out[after[rows][:, None] + 1 + np.arange(warm)] = plain[rows, :warm]
    rows = np.flatnonzero(pick == 2)
    word = (_LPC_BITS - 1) << 12 | 5 << 7 | factor[rows] & 0x7F
    out[after[rows] + 2], out[after[rows] + 3] = word >> 8, word & 0xFF
    sums = crc(out, starts[:-1], sizes - 2, 16)
    out[starts[1:] - 2], out[starts[1:] - 1] = sums >> 8, sums & 0xFF
    return out, sizes


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload of unsigned bytes; each length is a multiple of FRAME."""
    if not payloads:
        return []
    counts = np.array([len(p) // FRAME for p in payloads])
    data = np.frombuffer(b"".join(payloads), np.uint8)
    rows = (data.astype(np.int16) - 128).reshape(-1, FRAME)
    ends = np.cumsum(counts)
    numbers = np.arange(len(rows)) - np.repeat(ends - counts, counts)
    frames, sizes = encode_frames(rows, numbers)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw, out = frames.tobytes(), []
    for payload, end, n in zip(payloads, ends.tolist(), counts.tolist(), strict=True):
        own = sizes[end - n : end]
        offsets = np.concatenate([[0], np.cumsum(own)])
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", FRAME, FRAME) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        index = INDEX_ID + own.astype(">u2").tobytes()
        points = b"".join(struct.pack(">QQH", k * FRAME, int(offsets[k]), FRAME) for k in range(0, n, SEEK_FRAMES))
        meta = b"".join(bytes([kind]) + len(block).to_bytes(3, "big") + block for kind, block in ((0, info), (2, index), (0x83, points)))
        out.append(b"fLaC" + meta + raw[at[end - n] : at[end]])
    return out


class Stream:
    """The metadata of a stream: where frames begin, how many samples there are, the points for seeking."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.data, at, last = data, 4, False
        self.sizes, self.points = None, []
        while not last:
            kind, length = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            block, last, at = data[at + 4 : at + 4 + length], bool(kind & 0x80), at + 4 + length
            if kind & 0x7F == 0:
                word = int.from_bytes(block[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind & 0x7F == 2 and block[:4] == INDEX_ID:
                self.sizes = np.frombuffer(block[4:], ">u2").astype(np.int64)
            elif kind & 0x7F == 3:
                self.points = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, length, 18)]
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only one channel of up to 16 bits")
        self.first = at


class _Bits:
    """Reads bits at many places at once, through a 64-bit window at each byte."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.windows = np.ndarray((len(data) + 1,), ">u8", self.padded, 0, (1,))

    def at(self, place: np.ndarray) -> np.ndarray:
        """The bits from each place on, left-aligned; 57 of them are sure."""
        return self.windows[place >> 3].astype(np.uint64) << (place & 7).astype(np.uint64)

    def take(self, place: np.ndarray, n) -> np.ndarray:
        """n bits (up to 32) from each place, unsigned."""
        return (self.at(place) >> (np.uint64(64) - np.asarray(n, np.uint64))).astype(np.int64)

    def signed(self, place: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n, np.int64)
        value = self.take(place, n)
        return np.where(n > 0, value - ((value >> np.maximum(n - 1, 0) & 1) << n), 0)

    def zeros(self, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        """How many zero bits stand at each place before the next one."""
        q = 1075 - ((window >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
        if (long := np.flatnonzero(q > 52)).size:  # beyond the window
            further = place[long] + 53
            if int(further.max()) >> 3 >= len(self.windows):
                raise ValueError("a code has no end")
            q[long] = 53 + self.zeros(further, self.at(further))
        return q


def decode_frames(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples of the frames that begin at the given bytes, and where each ends. Checksums are verified."""
    bits = _Bits(data)
    if not ((data[starts] == 0xFF) & (data[starts + 1] >> 1 == 0x7C)).all():
        raise ValueError("no frame where one is said to begin")
    code, rate = data[starts + 2] >> 4, data[starts + 2] & 15
    if (data[starts + 3] >> 4 != 0).any():
        raise ValueError("only one channel")
    lead = data[starts + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + number_size
    c = code.astype(np.int64)
    size = np.select([c == 1, (c >= 2) & (c <= 5), c == 6, c == 7], [192, 576 << np.clip(c - 2, 0, 3), data[at].astype(np.int64) + 1, bits.take(8 * at, 16) + 1], 256 << np.maximum(c - 8, 0))
    at = at + np.where(c == 6, 1, 0) + np.where(c == 7, 2, 0)
    at = at + np.where(rate == 12, 1, 0) + np.where((rate == 13) | (rate == 14), 2, 0)
    if (crc(data, starts, at - starts, 8) != data[at]).any():
        raise ValueError("a frame header's checksum is wrong")
    at = at + 1
    kind = data[at]
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't supported")
    kind = (kind >> 1).astype(np.int64)
    linear = kind >= 32
    order = np.where(linear, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    coded = linear | (kind >= 8) & (kind <= 12)
    pos = 8 * (at + 1) + order * depth
    precision = bits.take(pos, 4) + 1
    shift = np.where(linear, bits.signed(pos + 4, 5), 0)
    weights = pos + 9
    pos = np.where(linear, pos + 9 + precision * order, pos)
    method, parts = bits.take(pos, 2), bits.take(pos + 2, 4)
    key = np.where(coded, ((size * 64 + kind) * 4 + method) * 16 + parts, -1 - np.minimum(kind, 2) - 4 * size)
    out: list = [None] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    for group in np.unique(key):
        lanes = np.flatnonzero(key == group)
        n, p = int(size[lanes[0]]), 8 * (at[lanes] + 1)
        if group < 0:
            if kind[lanes[0]] == 0:
                x, p = np.repeat(bits.signed(p, depth)[None], n, 0), p + depth
            elif kind[lanes[0]] == 1:
                x = bits.signed(p[None, :] + depth * np.arange(n)[:, None], depth)
                p = p + depth * n
            else:
                raise ValueError("unknown kind of subframe")
        else:
            o, wide = int(order[lanes[0]]), 5 if method[lanes[0]] else 4
            x = np.zeros((n, len(lanes)), np.int64)
            for t in range(o):
                x[t] = bits.signed(p + depth * t, depth)
            if linear[lanes[0]]:
                factors = [bits.signed(weights[lanes] + precision[lanes] * j, precision[lanes]) for j in range(o)]
            else:
                factors = [np.full(len(lanes), f) for f in _FIXED[o]]
            down, p, every = shift[lanes], pos[lanes] + 6, n >> int(parts[lanes[0]])
            for t in range(o, n):
                if t == o or t % every == 0:
                    k = bits.take(p, wide)
                    p = p + wide
                    escape = k == (1 << wide) - 1
                    raw = bits.take(p, 5) if escape.any() else None
                    p = p + np.where(escape, 5, 0)
                    low, top = np.uint64(64) - k.astype(np.uint64), int(k.max())
                window = bits.at(p)
                q = bits.zeros(p, window)
                start = p + q + 1
                rest = (window << (q + 1).astype(np.uint64)) >> low if int(q.max()) + top < 56 else bits.at(start) >> low
                rest = rest.astype(np.int64)
                u = q << k | rest
                r = u >> 1 ^ -(u & 1)
                after = start + k
                if raw is not None:
                    r = np.where(escape, bits.signed(p, np.where(escape, raw, 0)), r)
                    after = np.where(escape, p + raw, after)
                p = after
                if o:
                    guess = factors[0] * x[t - 1]
                    for j in range(1, o):
                        guess += factors[j] * x[t - 1 - j]
                    r = r + (guess >> down)
                x[t] = r
        ends[lanes] = (p + 7) // 8
        for lane, column in zip(lanes.tolist(), x.T, strict=True):
            out[lane] = column
    found = crc(data, starts, ends - starts, 16)
    if (found != (data[ends].astype(np.int64) << 8 | data[ends + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return out, ends + 2


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, checked against its digest."""
    parsed = [Stream(s) for s in streams]
    out: list = [None] * len(streams)
    indexed = [k for k, s in enumerate(parsed) if s.sizes is not None]
    for depth in sorted({parsed[k].bits for k in indexed}):
        own = [k for k in indexed if parsed[k].bits == depth]
        base, starts = 0, []
        for k in own:
            s = parsed[k]
            starts.append(base + s.first + np.concatenate([[0], np.cumsum(s.sizes)[:-1]]).astype(np.int64)[: len(s.sizes)])
            base += len(s.data)
        data = np.frombuffer(b"".join(parsed[k].data for k in own) + bytes(16), np.uint8)
        at, frames = 0, decode_frames(data, np.concatenate(starts), depth)[0] if len(np.concatenate(starts)) else []
        for k in own:
            n = len(parsed[k].sizes)
            out[k] = np.concatenate(frames[at : at + n]) if n else np.zeros(0, np.int64)
            at += n
    for k, s in enumerate(parsed):
        if s.sizes is None:
            data, at, done = np.frombuffer(s.data + bytes(16), np.uint8), s.first, []
            while at < len(s.data):
                frames, ends = decode_frames(data[at:], np.zeros(1, np.int64), s.bits)
                done.append(frames[0])
                at += int(ends[0])
            out[k] = np.concatenate(done) if done else np.zeros(0, np.int64)
        if len(out[k]) != s.samples and s.samples:
            raise ValueError("not as many samples as said")
        raw = out[k].astype(np.int8).tobytes() if s.bits <= 8 else out[k].astype("<i2").tobytes()
        if s.md5 != bytes(16) and hashlib.md5(raw).digest() != s.md5:
            raise ValueError("the samples' digest is wrong")
    return out


def read_from(stream: bytes, sample: int, count: int) -> np.ndarray:
    """Some samples only: frames before the nearest seek point aren't touched."""
    s = Stream(stream)
    near = max((p for p in s.points if p[0] <= sample), default=(0, 0, 0))
    data, at, have, done = np.frombuffer(stream + bytes(16), np.uint8), s.first + near[1], near[0], []
    while have < sample + count and at < len(stream):
        frames, ends = decode_frames(data[at : at + (1 << 18)], np.zeros(1, np.int64), s.bits)
        done.append(frames[0])
        have, at = have + len(frames[0]), at + int(ends[0])
    got = np.concatenate(done) if done else np.zeros(0, np.int64)
    return got[sample - near[0] :][:count]
