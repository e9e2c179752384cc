"""FLAC as a media column: bytes to a lossless stream of 8-bit mono samples and back.

Written streams use fixed or quantised linear predictors with Rice-coded residuals; reading verifies the checksums of
frame headers and frames and the digest of the samples, and yields PCM blocks with their sample offsets, from any sample on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, pieces, written

#: Samples in a frame, samples in a second (stated in the stream, without meaning here), frames between seek points.
BLOCK, RATE, SEEK = 4608, 8000, 64
#: Order of the fitted predictors that are tried beside the fixed ones.
LPC = 12
#: How the media table is written: copies of a stream on one page cost little.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: Payloads are filled with spaces up to a positive multiple of this.
UNIT = 192

#: Fixed values of the format: block sizes and sample sizes by code, coefficients of the fixed predictors.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class BadStream(ValueError):
    """A stream that breaks the format or whose checksums differ."""


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for v in range(256):
        v <<= width - 8
        for _ in range(8):
            v = ((v << 1) ^ polynomial) & mask if v & top else (v << 1) & mask
        table.append(v)
    return np.array(table, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_STEP = 256
#: Row d: contribution to the CRC-16 of each byte value with d bytes after it.
_AFTER = [_CRC16]
for _ in range(_STEP - 1):
    _AFTER.append((_AFTER[-1] << np.uint16(8)) ^ _CRC16[_AFTER[-1] >> np.uint16(8)])
_AFTER = np.stack(_AFTER)
_ROW = np.arange(_STEP - 1, -1, -1)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(_CRC8[out ^ b])
    return out


def crc16(data: bytes) -> int:
    """Blocks of _STEP bytes at once: a CRC is linear in the bytes."""
    head = len(data) % _STEP
    b = np.frombuffer(data, np.uint8)
    out = int(np.bitwise_xor.reduce(_AFTER[_ROW[_STEP - head :], b[:head]])) if head else 0
    for part in np.bitwise_xor.reduce(_AFTER[_ROW, b[head:].reshape(-1, _STEP)], axis=1):
        out = int(part) ^ int(_AFTER[_STEP - 1, out >> 8]) ^ int(_AFTER[_STEP - 2, out & 255])
    return out


def _number(n: int) -> bytes:
    """A frame or sample number, in the longer form of UTF-8 that the format uses."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *tail])


@lru_cache(4096)
def _bits(value: int, width: int) -> np.ndarray:
    """For use in concatenations only: the same array each time."""
    return (value >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _folded(residual: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Bits of residuals in one Rice partition, the residuals without signs, and the parameter."""
    u = (residual << 1) ^ (residual >> 31)
    mean = int(u.sum()) // max(len(u), 1)
    sizes = {k: int((u >> k).sum()) + len(u) * (k + 1) for k in range(max(0, min(14, mean.bit_length() - 2)), min(14, mean.bit_length()) + 1)}
    k = min(sizes, key=sizes.get)
    return sizes[k] + 10, u, k


def _rice(u: np.ndarray, k: int) -> np.ndarray:
    """Method and parameter of one partition, then each value: its quotient in zeros, a one, k bits."""
    end = np.cumsum((u >> k) + (1 + k), dtype=np.int64)
    out = np.zeros(int(end[-1]) if len(u) else 0, np.uint8)
    out[end - k - 1] = 1
    for j in range(k):
        out[end - 1 - j] = (u >> j) & 1
    return np.concatenate([_bits(0, 2), _bits(0, 4), _bits(k, 4), out])


_TEN = np.arange(9, -1, -1)


def _fitted(x: np.ndarray, order: int, precision: int = 10) -> tuple[list[int], int]:
    """Coefficients of a linear predictor by autocorrelation, quantised: whole numbers and the shift."""
    f, n = x.astype(float), len(x)
    r = np.array([f[: n - k] @ f[k:] for k in range(order + 1)])
    lag = np.abs(np.arange(order)[:, None] - np.arange(order))
    c = np.linalg.solve(r[lag] + np.eye(order) * (1e-6 * r[0] + 1e-6), r[1:])
    shift = max(0, min(15, precision - 2 - int(np.floor(np.log2(max(np.abs(c).max(), 1e-6))))))
    top = (1 << (precision - 1)) - 1
    return [int(v) for v in np.clip(np.round(c * 2**shift), -top, top)], shift


def _subframe(x: np.ndarray, lpc: int) -> np.ndarray:
    """Bits of the smallest subframe of 8-bit samples: constant, verbatim, fixed predictor, or (lpc > 0) a fitted one."""
    raw = (x & 255).astype(np.uint8)
    if (x == x[0]).all():
        return np.concatenate([_bits(0, 8), np.unpackbits(raw[:1])])
    best, order, d = None, 0, x
    for o in range(min(4, len(x) - 1) + 1):
        cost = int(np.abs(d[4 - o :] if len(x) > 4 else d).sum())
        if best is None or cost < best:
            best, order, residual = cost, o, d
        d = d[1:] - d[:-1]
    size, u, k = _folded(residual)
    head = [_bits(0, 1), _bits(8 + order, 6), _bits(0, 1), np.unpackbits(raw[:order])]
    size += 8 * order
    if lpc and len(x) > 4 * lpc:
        c, shift = _fitted(x, lpc)
        guess = np.floor(np.convolve(x.astype(float), c)[lpc - 1 : len(x) - 1] * 2.0**-shift).astype(np.int32)  # exact: below 2**53
        other, v, j = _folded(x[lpc:] - guess)
        if other + 18 * lpc + 9 < size:
            size, u, k = other + 18 * lpc + 9, v, j
            head = [_bits(0, 1), _bits(31 + lpc, 6), _bits(0, 1), np.unpackbits(raw[:lpc]), _bits(9, 4), _bits(shift, 5), (np.array(c)[:, None] >> _TEN & 1).astype(np.uint8).ravel()]
    if size >= 8 * len(raw):
        return np.concatenate([_bits(2, 8), np.unpackbits(raw)])
    return np.concatenate([*head, _rice(u, k)])


def encode(payload: bytes, block: int = BLOCK, lpc: int = LPC, seek: int = SEEK) -> bytes:
    """A FLAC stream of the payload's bytes, less 128, as 8-bit mono samples. lpc: order of fitted predictors, 0 for none."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    if not len(x):
        raise ValueError("a stream needs samples")
    frames, codes = [], {v: k for k, v in BLOCK_SIZES.items()}
    for i in range(0, len(x), block):
        part = x[i : i + block]
        code = codes.get(len(part), 7)
        head = bytes([0xFF, 0xF8, code << 4, 0b0000_001_0]) + _number(i // block) + ((len(part) - 1).to_bytes(2, "big") if code == 7 else b"")
        body = head + bytes([crc8(head)]) + np.packbits(_subframe(part, lpc)).tobytes()
        frames.append(body + crc16(body).to_bytes(2, "big"))
    at = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    points = b"".join((i * block).to_bytes(8, "big") + int(at[i]).to_bytes(8, "big") + min(block, len(x) - i * block).to_bytes(2, "big") for i in range(0, len(frames), seek))
    sizes = [len(f) for f in frames]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5((x & 255).astype(np.uint8).tobytes()).digest()
    if len(points) <= 18:  # a single point, at the start, tells nothing
        return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(frames)


#: Work that yields requests for positions of ones (see _together) and gets their answers.
Steps = Generator[tuple, np.ndarray, object]


class _Bits:
    """Reads a frame's bits, one byte for each, from a position on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        b = np.frombuffer(data + b"\0\0\0", np.uint8)
        self.bits = np.unpackbits(b[:-3])
        self.window = b[:-2].astype(np.int32) << 16 | b[1:-1].astype(np.int32) << 8 | b[2:]  # 24 bits from each byte on

    def uint(self, width: int) -> int:
        begin, self.at = self.at, self.at + width
        if self.at > len(self.bits):
            raise BadStream("the frame ends early")
        end = (self.at + 7) // 8
        return int.from_bytes(self.data[begin // 8 : end], "big") >> (8 * end - self.at) & ((1 << width) - 1)

    def int(self, width: int) -> int:
        v = self.uint(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def ints(self, n: int, width: int) -> np.ndarray:
        out = self._fields(self.at + np.arange(n) * width, width)
        self.at += n * width
        return out - ((out >> max(width - 1, 0) & 1) << width) if width else out

    def _fields(self, start: np.ndarray, width: int) -> np.ndarray:
        if len(start) and start[-1] + width > len(self.bits):
            raise BadStream("the frame ends early")
        if width <= 17:
            return (self.window[start >> 3] >> (24 - width - (start & 7)) & ((1 << width) - 1)).astype(np.int64)
        return self._fields(start, 16) << (width - 16) | self._fields(start + 16, width - 16)

    def rice(self, n: int, k: int) -> Steps:
        """n folded values: as many zeros as the quotient, a one, k bits."""
        one = yield self.bits, self.at, n, k
        if n and one[-1] + k >= len(self.bits):
            raise BadStream("the frame ends early")
        begin = np.empty(n, np.int64)
        begin[:1], begin[1:] = self.at, one[:-1] + (1 + k)
        u = (one - begin) << k | self._fields(one + 1, k)
        self.at = int(one[-1]) + 1 + k if n else self.at
        return (u >> 1) ^ -(u & 1)


#: Frames of a stream that are read before their samples are restored together.
GATHERED = 256
#: Requests below this number are read one by one.
FEW = 16


def _together(requests: list[tuple[np.ndarray, int, int, int]]) -> list[np.ndarray]:
    """For requests (bits, position, n, k): positions of the n ones that end the quotients, len(bits) where bits run out.

    Each value's place depends on the one before, so one step is taken in all requests at once.
    """
    order = sorted(range(len(requests)), key=lambda i: -requests[i][2])
    picked = [requests[i] for i in order]
    # Together as long as at least FEW requests have values left; what remains of the longest is read one by one.
    n = [r[2] for r in picked]
    until = n[FEW - 1] if len(n) >= FEW else 0
    size = np.array([len(r[0]) + 1 for r in picked])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    out, reached = np.empty((until, len(picked)), np.int64), np.array([r[1] for r in picked])
    if until:
        bits = np.ones(int(size.sum()), np.uint8)  # a stop after the end of each
        for at, (a, _, _, _) in zip(base, picked, strict=True):
            bits[at : at + len(a)] = a
        count = np.cumsum(bits, dtype=np.int32)
        count -= bits
        following = np.flatnonzero(bits)[count]
        gap, p, active = np.array([r[3] + 1 for r in picked]), base + reached, len(picked)
        for step in range(until):
            if n[active - 1] <= step:
                active = next(i for i in range(active - 1, -1, -1) if n[i] > step) + 1
                p, gap = p[:active], gap[:active]
            one = out[step, :active]
            following.take(p, mode="clip", out=one)
            p = one + gap
        out -= base
        reached[:active] = p - base[:active]
    found: list = [None] * len(requests)
    for j, i in enumerate(order):
        found[i] = out[: n[j], j]
        if n[j] > until:
            a, _, _, k = picked[j]
            find, p, more = a.tobytes().find, int(reached[j]), []
            for _ in range(n[j] - until):
                one = find(1, p)
                more.append(len(a) if one < 0 else one)
                p = more[-1] + 1 + k
            found[i] = np.concatenate([found[i], more]).astype(np.int64)
    return found


#: Samples that are restored in one table at most.
TABLE = 2 << 20


def _restored(parts: list[tuple]) -> list[np.ndarray]:
    """Samples of subframes with fitted predictors (first samples, residuals, coefficients, shift, wasted bits).

    Each sample needs those before it, so one sample of all the subframes is made at a time, the longest subframes first.
    """
    order, out, at = sorted(range(len(parts)), key=lambda i: -len(parts[i][1])), [None] * len(parts), 0
    while at < len(order):
        longest = len(parts[order[at]][1])
        some = order[at : at + max(1, TABLE // max(1, longest))]
        at += len(some)
        p = max(len(parts[i][0]) for i in some)
        x, c = np.zeros((p + longest, len(some)), np.int64), np.zeros((p, len(some)), np.int64)
        shift = np.array([parts[i][3] for i in some])
        size = np.array([len(parts[i][1]) for i in some])
        for j, i in enumerate(some):
            first, residual, coefficients, _, _ = parts[i]
            x[p - len(first) : p, j], x[p : p + len(residual), j], c[p - len(first) :, j] = first, residual, coefficients[::-1]
        active = len(some)
        for t in range(longest):
            while size[active - 1] <= t:
                active -= 1
            x[p + t, :active] += np.einsum("of,of->f", c[:, :active], x[t : t + p, :active]) >> shift[:active]
        for j, i in enumerate(some):
            first, wasted = parts[i][0], parts[i][4]
            out[i] = x[p - len(first) : p + size[j], j] << wasted
    return out


def _solve(work: list[Steps]) -> list:
    """Runs all of work at once, answering their requests together; results in order."""
    out, waiting = [None] * len(work), {}

    def go(i: int, answer) -> None:
        try:
            waiting[i] = work[i].send(answer)
        except StopIteration as end:
            out[i] = end.value

    for i in range(len(work)):
        go(i, None)
    while waiting:
        asked = dict(waiting)
        waiting.clear()
        rice, fitted = [i for i in asked if isinstance(asked[i], tuple)], [i for i in asked if isinstance(asked[i], list)]
        for i, answer in zip(rice, _together([asked[i] for i in rice]), strict=True):
            go(i, answer)
        if fitted and not rice:  # subframes to restore gather until nothing else can be done
            every = iter(_restored([x for i in fitted for x in asked[i]]))
            for i in fitted:
                go(i, [next(every) for _ in asked[i]])
        else:
            waiting.update({i: asked[i] for i in fitted})
    return out


def _residual(r: _Bits, n: int, order: int) -> Steps:
    method = r.uint(2)
    if method > 1:
        raise BadStream("unknown residual coding")
    width, parts, out = 4 + method, 1 << r.uint(4), []
    if n % parts:
        raise BadStream("partitions don't fit the block")
    for i in range(parts):
        k, size = r.uint(width), n // parts - (order if i == 0 else 0)
        out.append(r.ints(size, r.uint(5)) if k == (1 << width) - 1 else (yield from r.rice(size, k)))
    return np.concatenate(out)


def _samples(r: _Bits, n: int, depth: int) -> Steps:
    """Samples of one subframe; for a fitted predictor what _restored() makes them of."""
    r.uint(1)
    kind, wasted = r.uint(6), r.uint(1)
    while wasted and not r.uint(1):
        wasted += 1
    depth -= wasted
    if kind == 0:
        x = np.full(n, r.int(depth), np.int64)
    elif kind == 1:
        x = r.ints(n, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = r.ints(order, depth)
        x = yield from _residual(r, n, order)
        for o in range(order, 0, -1):  # sums undo differences, the last first
            lead = np.diff(first, o - 1)[-1] if o > 1 else first[-1]
            x = lead + np.cumsum(x)
        x = np.concatenate([first, x])
    elif kind >= 32:
        order = kind - 31
        first = r.ints(order, depth)
        width, shift = r.uint(4) + 1, r.int(5)
        c = [r.int(width) for _ in range(order)]
        return first, (yield from _residual(r, n, order)), c, shift, wasted
    else:
        raise BadStream("unknown subframe")
    return x << wasted


def info(stream: bytes) -> dict:
    """Block size, rate, channels, depth, samples, digest, seek points (sample, byte, samples) and the first frame's byte."""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC stream")
    at, out, last = 4, {"seek": []}, 0
    while not last:
        if at + 4 > len(stream):
            raise BadStream("the metadata ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        data, at = stream[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            v = int.from_bytes(data[10:18], "big")
            out |= {"block": int.from_bytes(data[2:4], "big"), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "depth": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": data[18:34]}
        elif kind == 3:
            out["seek"] = [(int.from_bytes(data[i : i + 8], "big"), int.from_bytes(data[i + 8 : i + 16], "big"), int.from_bytes(data[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
    return out | {"frames": at}


def _frame(stream: bytes, at: int, meta: dict) -> Steps:
    """Number of the first sample, subframes, how channels are coded, and where the next frame begins; both checksums are verified."""
    if stream[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise BadStream("no frame here")
    code, rate, channels, depth = stream[at + 2] >> 4, stream[at + 2] & 15, stream[at + 3] >> 4, stream[at + 3] >> 1 & 7
    lead = stream[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for b in stream[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    p = at + 5 + more
    n = BLOCK_SIZES.get(code) or int.from_bytes(stream[p : p + code - 5], "big") + 1
    p += (code - 5 if code in (6, 7) else 0) + RATE_BYTES.get(rate, 0)
    if p >= len(stream) or crc8(stream[at:p]) != stream[p]:
        raise BadStream("a frame header's checksum differs")
    depth = SAMPLE_SIZES.get(depth, meta["depth"])
    sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channels, (0,) * (channels + 1))
    usual = p + 1 + len(sides) * (n * (depth + 1) // 8 + 64)  # bytes of verbatim subframes; larger ones are odd
    for end in (usual, len(stream)):
        r, x = _Bits(stream[p + 1 : end]), []
        try:
            for side in sides:
                x.append((yield from _samples(r, n, depth + side)))
            break
        except BadStream:
            if end >= len(stream):
                raise
    end = p + 1 + (r.at + 7) // 8
    if crc16(stream[at:end]) != int.from_bytes(stream[end : end + 2], "big"):
        raise BadStream("a frame's checksum differs")
    return number if stream[at + 1] & 1 else number * meta["block"], x, channels, end + 2


def _joined(x: list[np.ndarray], channels: int) -> np.ndarray:
    """Samples by channel from a frame's subframes."""
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x)


def _blocks(stream: bytes, start: int) -> Steps:
    """PCM blocks of a stream; the samples' digest is compared where all are read."""
    meta, out = info(stream), []
    at = meta["frames"] + max((byte for sample, byte, _ in meta["seek"] if sample <= start), default=0)
    digest, size = hashlib.md5(), max(1, -(-meta["depth"] // 8))
    while at < len(stream):
        frames = []
        while at < len(stream) and len(frames) < GATHERED:
            *frame, at = yield from _frame(stream, at, meta)
            frames.append(frame)
        parts = [x for _, subframes, _ in frames for x in subframes if isinstance(x, tuple)]
        made = iter((yield parts) if parts else ())
        for first, subframes, channels in frames:
            x = _joined([next(made) if isinstance(x, tuple) else x for x in subframes], channels)
            if start == 0:
                digest.update(np.ascontiguousarray(x.T, "<i8").view(np.uint8).reshape(x.shape[1], x.shape[0], 8)[:, :, :size].tobytes())
            if first + x.shape[1] > start:
                out.append((first, x.astype(np.int16 if meta["depth"] <= 16 else np.int32)))
    if start == 0 and any(meta["md5"]) and digest.digest() != meta["md5"]:
        raise BadStream("the samples' digest differs")
    return out


def decode(streams: list[bytes], start: int = 0) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks (offset of the first sample, samples by channel) of each stream from the block with sample ``start`` on."""
    return _solve([_blocks(s, start) for s in streams])


def padded(text: str | None) -> tuple[int, bytes]:
    """Number of bytes of a text in UTF-8 (null: 0), and these filled with spaces to a positive multiple of UNIT."""
    b = (text or "").encode("utf-8", "replace")
    return len(b), b.ljust(max(1, -(-len(b) // UNIT)) * UNIT, b" ")


def stored(docs: DataFrame, text: str = "text", lpc: int = LPC) -> DataFrame:
    """docs with n_bytes and media, the FLAC stream of the padded text, in place of the text. Null texts count as empty.

    lpc: order of fitted predictors that are tried beside the fixed ones, 0 for none. Other columns are kept, columns of
    these names replaced.
    """
    docs = docs.drop("n_bytes", "media")
    keep = [c for c in docs.columns if c != text]
    schema = extended(docs.select(*keep), n_bytes="long", media="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, rows=256):
            pairs = [padded(t) for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([n for n, _ in pairs], pa.int64()), pa.array([encode(p, lpc=lpc) for _, p in pairs], pa.binary())], [*keep, "n_bytes", "media"])

    return docs.mapInArrow(run, schema)


def _sets(streams: list[bytes | None]) -> Iterator[range]:
    """Places of the streams that are decoded together: at most 512, and at most 2 MB unless a single one is longer."""
    at, size = 0, 0
    for i, s in enumerate(streams):
        if i > at and (i - at == 512 or size + len(s or b"") > 2 << 20):
            yield range(at, i)
            at, size = i, 0
        size += len(s or b"")
    yield range(at, len(streams))


def pcm(media: DataFrame, start: int = 0, outer: bool = False) -> DataFrame:
    """One row for each PCM block of each stream: the other columns, sample_offset, n_samples, pcm (8-bit mono as bytes).

    A stream's rows follow each other in order. A null or empty stream has none, or with ``outer`` one with nulls.
    """
    keep = [c for c in media.columns if c not in ("media", "sample_offset", "n_samples", "pcm")]
    schema = extended(media.select(*keep), sample_offset="long", n_samples="int", pcm="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch["media"].to_pylist()
            for some in _sets(streams):
                there, rows = iter(decode([streams[i] for i in some if streams[i]], start)), []
                for i in some:
                    if streams[i]:
                        rows += ((i, first, x.shape[1], (x[0].astype(np.int16) + 128).astype(np.uint8).tobytes()) for first, x in next(there))
                    elif outer:
                        rows.append((i, None, None, None))
                if rows:
                    of, first, size, data = zip(*rows, strict=True)
                    new = [pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(of)) for c in keep), *new], [*keep, "sample_offset", "n_samples", "pcm"])

    return media.mapInArrow(run, schema)


class _Stream:
    """Running digests and sums over a stream's PCM blocks."""

    def __init__(self):
        self.digest, self.tail, self.n, self.blocks, self.total, self.steps, self.turns, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, offset: int, block: bytes) -> None:
        if offset != self.n:
            raise BadStream("a block is missing")
        self.digest.update(block)
        x = np.frombuffer(block, np.uint8).astype(np.int32) - 128
        self.tail, self.n, self.blocks = (self.tail + block)[-16:], self.n + len(block), self.blocks + 1
        y = x if self.last is None else np.concatenate([[self.last], x])
        self.total, self.steps, self.last = self.total + int(x.sum(dtype=np.int64)), self.steps + int(np.abs(np.diff(y)).sum(dtype=np.int64)), x[-1]
        self.turns += int(np.count_nonzero((y[:-1] < -32) != (y[1:] < -32)))

    def out(self) -> tuple:
        if not self.n:
            return None, None, None, None
        n = self.n
        return n, self.digest.hexdigest(), zlib.crc32(self.tail), f"{self.blocks}:{self.total / n:.4f}:{self.steps / n:.4f}:{self.turns / n:.4f}"


def measured(media: DataFrame) -> DataFrame:
    """media (.., n_bytes, media) read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    feature: number of blocks, mean of the samples, their mean step and the share of sign changes, over the whole stream.
    A null stream gives nulls. Taken from the rows of pcm(), a stream's from its block at sample 0 to the next such block.
    """
    new = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "feature": "string"}
    media = media.drop(*new, "media_bytes", "media_sha256", "sample_offset", "n_samples", "pcm")
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    keep = [c for c in media.columns if c != "media"]
    schema = extended(media.select(*keep), **kinds)

    def put(streams: list[tuple[pa.RecordBatch, _Stream]]) -> pa.RecordBatch:
        got = list(zip(*(s.out() for _, s in streams), strict=True))
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays([row[c] for row, _ in streams]) for c in keep), *(pa.array(v, t) for v, t in zip(got, new.values(), strict=True))], [*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = []
        for batch in batches:
            others = batch.select(keep)
            for i, (offset, block) in enumerate(zip(batch["sample_offset"].to_pylist(), batch["pcm"].to_pylist(), strict=True)):
                if not offset:
                    if len(streams) == 512:
                        yield put(streams)
                        streams = []
                    streams.append((others.slice(i, 1), _Stream()))
                if offset is not None:
                    streams[-1][1].add(offset, block)
        if streams:
            yield put(streams)

    return pcm(media, outer=True).mapInArrow(run, schema)


def digest(docs: DataFrame, lpc: int = LPC) -> DataFrame:
    """The columns of op9. The media table is written to the shared folder, and all digests are of what is read back from it."""
    media = written(stored(docs.select("doc_id", "text"), lpc=lpc), "media", **PACKED)
    return measured(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
