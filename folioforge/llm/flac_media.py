"""Media columns as FLAC: 8-bit mono streams, written and read with numpy over many frames.

A payload's bytes, less 128, are the samples, in frames of four times 576. Each frame is stored by
the cheapest of a constant, fixed predictors of order 0 to 2, a linear predictor of order 4, or
verbatim; residuals are Rice-coded in up to four partitions. A seek point per frame holds its first
sample and its place, so any block is read without the frames before it, and a batch's frames
are decoded side by side: the residuals of one sample of all frames at a time. A stream without
a point for every frame (the table holds 932,067 at most, so beyond ``MOST_POINTS`` frames
only every so many get one) is cut at its frame headers instead. Reading checks the header's
CRC-8, the frame's CRC-16, and the MD5 of all samples.

``media_table`` writes the streams to the shared folder, ``read_back`` digests what is read
from there, and ``pcm_blocks`` decodes the streams to a written table of PCM blocks, each with
its first sample, from which ``samples_at`` takes single samples by an equi-join.

The decoder reads mono streams of 4 to 16 bits with constant, verbatim, fixed and linear
subframes, both Rice codings, any partition order, and escaped partitions.

Cases: null text is empty; an empty payload is padded to one frame; a very long text is one
stream, encoded and decoded by itself; equal texts give equal streams; repeated rows, and rows
without an id, stay; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import slices, tidy, utf8_of
from folioforge.plans.scratch import written

BLOCK = 576
RATE = 8000
PAD = 255
LPC_ORDER, LPC_PRECISION = 4, 12
#: Coefficients of the fixed predictors by order (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Samples of a frame by its block-size code, where the code alone gives it (fixed values of the format).
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 256 << (c - 8) for c in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16}
MOST_ZEROS = 24
FRAMES = 4096
#: Samples of a frame; the last one of a stream has fewer.
FRAME = 4 * BLOCK
MOST_POINTS = 900_000
#: Samples of a row of ``pcm_blocks``.
PCM_BLOCK = 8 * BLOCK


class BrokenStream(ValueError):
    """A stream that isn't FLAC of the kind read here, or whose checks fail."""


def _table(poly: int, bits: int, steps: int) -> np.ndarray:
    crc = np.arange(1 << steps, dtype=np.int64) << (bits - steps if bits > steps else 0)
    for _ in range(steps):
        crc = np.where(crc & (1 << (bits - 1)), (crc << 1) ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc


CRC8 = _table(0x07, 8, 8).astype(np.uint8)
#: Of two bytes at a time.
CRC16 = _table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range of ``flat``; leading zeros leave it as it is, so all end together."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    width = int((ends - starts).max())
    width += width % 2
    at = ends[:, None] - width + np.arange(width)
    rows = np.where(at >= starts[:, None], flat[np.maximum(at, 0)], 0).astype(np.uint16)
    words = np.ascontiguousarray(((rows[:, 0::2] << 8) | rows[:, 1::2]).T)
    crc = np.zeros(len(starts), np.uint16)
    for w in words:
        crc = CRC16[crc ^ w]
    return crc


def frame_number(n: int) -> bytes:
    """The coding of UTF-8, up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room = 6 - len(tail)
        if n < 1 << room:
            return bytes([((0xFF << (room + 1)) & 0xFF) | n, *reversed(tail)])


def _header(n: int, size: int) -> bytes:
    code, tail = next(((c, b"") for c, s in BLOCK_SIZES.items() if s == size), (7, (size - 1).to_bytes(2, "big")))
    head = b"\xff\xf8" + bytes([code << 4 | 0x04, 0x02]) + frame_number(n) + tail  # 8 kHz; mono, 8 bits
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x order) and shifts, by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float64)
    auto = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - j], f[:, j:]) for j in range(LPC_ORDER + 1)], 1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-6
    a = np.zeros((len(x), LPC_ORDER))
    err = auto[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], auto[:, i:0:-1])) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(LPC_PRECISION - 2 - np.frexp(top)[1], 0, 14).astype(np.int64)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _partitions(u: np.ndarray, size: int) -> np.ndarray:
    """Frames x partitions x samples of residuals, zeros in the place of warm-up samples."""
    missing = size - u.shape[1]
    whole = np.concatenate((np.zeros((len(u), missing), u.dtype), u), 1) if missing else u
    return whole.reshape(len(u), 1 << _partition_order(size), -1)


def _partition_order(size: int) -> int:
    return (size // BLOCK).bit_length() - 1 if size % (2 * BLOCK) == 0 else 0


def _rice(res: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best parameters per frame and partition, and the bits that all of a frame's codes take."""
    u = _partitions(_zigzag(res), size)
    n = np.full(u.shape[1], u.shape[2])
    n[0] -= size - res.shape[1]
    mean = u.sum(2) / np.maximum(n, 1)
    k0 = np.clip(np.frexp(np.maximum(mean * 0.7, 0.5))[1] - 1, 0, 13)
    need = np.clip(np.frexp((u.max(2) // MOST_ZEROS).astype(np.float64))[1], 0, 14)
    k0 = np.maximum(k0, need)
    cost0 = (u >> k0[:, :, None]).sum(2) + n * (k0 + 1)
    k1 = np.minimum(k0 + 1, 14)
    cost1 = (u >> k1[:, :, None]).sum(2) + n * (k1 + 1)
    return np.where(cost1 < cost0, k1, k0), (np.minimum(cost0, cost1) + 4).sum(1)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _coded(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of equal size, each row of samples one, with their numbers in their streams."""
    n, size = x.shape
    coefs, shifts = _linear(x)
    residuals = [x, x[:, 1:] - x[:, :-1]]
    residuals.append(residuals[1][:, 1:] - residuals[1][:, :-1])
    guess = np.zeros((n, size - LPC_ORDER), np.int32)
    narrow = coefs.astype(np.int32)
    for j in range(LPC_ORDER):
        guess += narrow[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : size - 1 - j]
    residuals.append((x[:, LPC_ORDER:] - (guess >> shifts.astype(np.int32)[:, None])))
    orders, extra = [0, 1, 2, LPC_ORDER], [0, 0, 0, 9 + LPC_ORDER * LPC_PRECISION]
    # The predictor with the least residuals, by the bits their mean size asks for in each partition.
    asked = [np.log2(np.abs(_partitions(r, size)).mean(2, dtype=np.float32) + np.float32(0.5)).mean(1) for r in residuals]
    best = (size * np.stack(asked, 1) + np.array([8 * o + e for o, e in zip(orders, extra, strict=True)])).argmin(1)
    parts = 1 << _partition_order(size)
    rice: list[tuple[np.ndarray, np.ndarray]] = []
    coded = np.empty(n, np.int64)
    for k in range(4):
        i = np.flatnonzero(best == k)
        par, taken = _rice(residuals[k][i], size) if len(i) else (np.zeros((0, parts), np.int64), np.zeros(0, np.int64))
        full = np.zeros((n, parts), np.int64)
        full[i] = par
        coded[i] = 8 + 8 * orders[k] + extra[k] + 6 + taken
        rice.append((full, taken))
    constant = (x == x[:, :1]).all(1)
    costs = np.stack([np.where(best == k, coded, 1 << 40) for k in range(4)] + [np.full(n, 8 + 8 * size), np.where(constant, 16, 1 << 40)], 1)
    kind = costs.argmin(1)
    bits_of = costs[np.arange(n), kind]
    heads = [_header(i, size) for i in numbers.tolist()]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    sizes = head_len + (bits_of + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint8)
    joined = np.frombuffer(b"".join(heads), np.uint8)
    before = np.cumsum(head_len) - head_len
    flat[np.repeat(starts - before, head_len) + np.arange(len(joined))] = joined
    bits = np.zeros(len(flat) * 8, np.uint8)
    at = (starts + head_len) * 8
    code = np.choose(kind, [8, 9, 10, 32 + LPC_ORDER - 1, 1, 0])
    _put(bits, at, code << 1, 8)
    at = at + 8
    for k, samples in ((4, size), (5, 1)):
        i = np.flatnonzero(kind == k)
        _put(bits, at[i][:, None] + 8 * np.arange(samples), x[i, :samples] & 255, 8)
    for k in range(4):
        i = np.flatnonzero(kind == k)
        if not len(i):
            continue
        p, o = at[i], orders[k]
        if o:
            _put(bits, p[:, None] + 8 * np.arange(o), x[i, :o] & 255, 8)
            p = p + 8 * o
        if k == 3:
            _put(bits, p, np.full(len(i), LPC_PRECISION - 1), 4)
            _put(bits, p + 4, shifts[i], 5)
            _put(bits, p[:, None] + 9 + LPC_PRECISION * np.arange(o), coefs[i] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            p = p + 9 + LPC_PRECISION * o
        pars = rice[k][0][i]
        _put(bits, p + 2, np.full(len(i), _partition_order(size)), 4)  # Rice coding 0
        u = _zigzag(residuals[k][i])
        part = (np.arange(o, size) * parts) // size
        heads_at = np.flatnonzero(np.diff(part, prepend=-1))
        par = pars[:, part]
        long = (u >> par) + par + 1
        long[:, heads_at] += 4  # the parameter stands before a partition's first code
        ends = p[:, None] + 6 + np.cumsum(long, 1)
        _put(bits, ends[:, heads_at] - long[:, heads_at], pars[:, part[heads_at]], 4)
        for v in np.unique(pars).tolist():
            mine = par == v
            stop, low = ends[mine] - v - 1, u[mine]
            bits[stop] = 1
            for j in range(v):
                bits[stop + 1 + j] = (low >> (v - 1 - j)) & 1
    flat |= np.packbits(bits)
    crc = crc16(flat, starts, starts + sizes - 2)
    flat[starts + sizes - 2], flat[starts + sizes - 1] = crc >> 8, crc & 255
    raw = flat.tobytes()
    return [raw[a : a + b] for a, b in zip(starts.tolist(), sizes.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose length is a positive multiple of 576."""
    if not payloads:
        return []
    lengths = np.array(list(map(len, payloads)))
    counts = -(-lengths // FRAME)
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    numbers = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = np.repeat(np.cumsum(lengths) - lengths, counts) + numbers * FRAME
    sizes = np.minimum(np.repeat(lengths, counts) - numbers * FRAME, FRAME)
    frames: list[bytes] = [b""] * len(sizes)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for i, frame in zip(rows.tolist(), _coded(x[begins[rows][:, None] + np.arange(size)], numbers[rows]), strict=True):
            frames[i] = frame
    out, first = [], 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        mine = frames[first : first + count]
        long = np.fromiter(map(len, mine), np.int64, count)
        points = np.zeros(count, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(count) * FRAME, np.cumsum(long) - long, sizes[first : first + count]
        signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        block = min(FRAME, len(payload))
        info = struct.pack(">HH", block, block) + int(long.min()).to_bytes(3, "big") + int(long.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = points[:: -(-count // MOST_POINTS)].tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(mine))
        first += count
    return out


def read_layout(stream: bytes) -> dict:
    """Metadata of a stream: ``bits, samples, md5, audio`` (where frames begin) and ``frames``, their offsets."""
    if stream[:4] != b"fLaC":
        raise BrokenStream("no FLAC stream")
    at, last, info, seek = 4, False, b"", b""
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, kind, body = kind >= 128, kind & 127, stream[at + 4 : at + 4 + size]
        info, seek = body if kind == 0 else info, body if kind == 3 else seek
        at += 4 + size
    word = int.from_bytes(info[10:18], "big")
    if (word >> 41) & 7:
        raise BrokenStream("not mono")
    out = {"bits": ((word >> 36) & 31) + 1, "samples": word & ((1 << 36) - 1), "md5": info[18:34], "audio": at, "block": int.from_bytes(info[:2], "big")}
    points = np.frombuffer(seek, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    frames = -(-out["samples"] // out["block"])
    if len(points) == frames and (points["sample"] == np.arange(frames) * out["block"]).all():
        out["frames"] = points["offset"].astype(np.int64) + at
    else:
        out["frames"] = np.array(_scan(stream, at, frames), np.int64)
    return out


def _scan(stream: bytes, at: int, frames: int) -> list[int]:
    """Frame starts by their headers, each proved by its CRC-8 and by the CRC-16 of the frame before."""
    found: list[int] = []
    flat = np.frombuffer(stream, np.uint8)
    place = at
    while len(found) < frames:
        place = stream.find(b"\xff\xf8", place)
        if place < 0:
            raise BrokenStream("a frame is missing")
        head = stream[place : place + 4] + frame_number(len(found))
        extra = {6: 1, 7: 2}.get(head[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
        head += stream[place + len(head) : place + len(head) + extra]
        good = stream[place : place + len(head)] == head and place + len(head) < len(stream) and crc8(head) == stream[place + len(head)]
        if good and found:
            good = int(crc16(flat, np.array([found[-1]]), np.array([place - 2]))[0]) == int.from_bytes(stream[place - 2 : place], "big")
        if good:
            found.append(place)
        place += 1
    return found


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, as int32, after all checks."""
    layouts = [read_layout(s) for s in streams]
    if not layouts:
        return []
    base = np.cumsum([0, *map(len, streams)])
    flat = np.frombuffer(b"".join(streams), np.uint8)
    starts = np.concatenate([lay["frames"] + b for lay, b in zip(layouts, base, strict=False)])
    ends = np.concatenate([np.append(lay["frames"][1:], len(s)) + b for lay, s, b in zip(layouts, streams, base, strict=False)])
    bad = crc16(flat, starts, ends - 2) != (flat[ends - 2].astype(np.uint16) << 8 | flat[ends - 1])
    if bad.any():
        raise BrokenStream(f"CRC-16 of {int(bad.sum())} frames")
    counts = [len(lay["frames"]) for lay in layouts]
    sizes = np.concatenate([np.minimum(lay["block"], lay["samples"] - np.arange(c) * lay["block"]) for lay, c in zip(layouts, counts, strict=True)])
    depth = np.repeat([lay["bits"] for lay in layouts], counts)
    frames: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
    order = np.lexsort((depth, sizes))
    keys = np.stack([sizes[order], depth[order]], 1)
    edges = np.flatnonzero(np.any(np.diff(keys, axis=0), axis=1)) + 1
    for i in np.split(order, edges):
        for j in range(0, len(i), FRAMES):
            rows = i[j : j + FRAMES]
            for r, got in zip(rows.tolist(), _frames(flat, starts[rows], int(sizes[rows[0]]), int(depth[rows[0]])), strict=True):
                frames[r] = got
    out, first = [], 0
    for lay, c in zip(layouts, counts, strict=True):
        samples = np.concatenate(frames[first : first + c]) if c else np.zeros(0, np.int32)
        first += c
        kind = np.int8 if lay["bits"] <= 8 else np.dtype("<i2")
        if any(lay["md5"]) and hashlib.md5(samples.astype(kind).tobytes()).digest() != lay["md5"]:
            raise BrokenStream("MD5 of the samples")
        out.append(samples)
    return out


class _Bits:
    """Reads bits of many places of one buffer at once."""

    def __init__(self, flat: np.ndarray):
        padded = np.concatenate((flat, np.zeros(16, np.uint8)))
        self.words = np.lib.stride_tricks.as_strided(padded.view(), (len(flat) + 8, 8), (1, 1))
        self.view = np.ndarray((len(flat) + 8,), ">u8", padded, 0, (1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least from each place, at the top of 64."""
        return self.view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def get(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(at), np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.get(at, width)
        return v - ((v >> (width - 1)) << width) if width else v


def _frames(flat: np.ndarray, starts: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Frames of one size, decoded side by side: frames x samples."""
    n = len(starts)
    low, high = int(starts.min()), min(len(flat), int(starts.max()) + size * 8 + 64)
    view = flat[low:high]
    read, at0 = _Bits(view), starts - low
    if (view[at0] != 0xFF).any() or (view[at0 + 1] & 0xFE != 0xF8).any():
        raise BrokenStream("no frame where one should be")
    code, lead = view[at0 + 2], view[at0 + 4]
    number = np.ones(n, np.int64) + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC) + (lead >= 0xFE)
    extra = np.isin(code >> 4, (6,)) + 2 * np.isin(code >> 4, (7,)) + np.isin(code & 15, (12,)) + 2 * np.isin(code & 15, (13, 14))
    head = 4 + number + extra
    crc = np.zeros(n, np.uint8)
    for j in range(int(head.max())):
        crc = np.where(j < head, CRC8[crc ^ view[at0 + j]], crc)
    if (crc != view[at0 + head]).any():
        raise BrokenStream("CRC-8 of a frame header")
    at = (at0 + head + 1) * 8
    first = read.get(at, 8)
    at = at + 8
    if (first & 1).any():
        raise BrokenStream("wasted bits are not read here")
    kind = first >> 1
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (~np.isin(kind, (0, 1)) & ~((kind >= 8) & (kind <= 12)) & (kind < 32)).any():
        raise BrokenStream("an unknown subframe")
    most = max(1, int(order.max()))
    x = np.zeros((most + size, n), np.int64)
    coefs, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    i = np.flatnonzero(kind == 0)
    x[most:, i] = read.signed(at[i], depth)
    i = np.flatnonzero(kind == 1)
    for t in range(size if len(i) else 0):
        x[most + t, i] = read.signed(at[i] + t * depth, depth)
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return x[most:].T.astype(np.int32)
    for t in range(most):
        i = np.flatnonzero((kind >= 8) & (order > t))
        x[most + t, i] = read.signed(at[i], depth)
        at[i] += depth
    for o in range(1, 5):
        i = np.flatnonzero(kind == 8 + o)
        for j, c in enumerate(FIXED[o] if len(i) else ()):
            coefs[j, i] = c
    i = np.flatnonzero(kind >= 32)
    if len(i):
        precision = read.get(at[i], 4) + 1
        shift[i] = read.signed(at[i] + 4, 5)
        at[i] += 9
        for p in np.unique(precision).tolist():
            for t in range(most):
                k = i[(precision == p) & (order[i] > t)]
                coefs[t, k] = read.signed(at[k], p)
                at[k] += p
    method = read.get(at, 2)
    wide = np.where(method == 1, 5, 4)
    parts = read.get(at + 2, 4)
    at[coded] += 6
    span = size >> parts
    par, raw = np.zeros(n, np.int64), np.zeros(n, bool)
    one = np.uint64(1)
    for t in range(size):
        new = coded[(t % span[coded] == 0) | (t == 0)] if t == 0 or (parts[coded] > 0).any() else coded[:0]
        for w in (4, 5):
            k = new[wide[new] == w]
            if len(k):
                par[k] = read.get(at[k], w)
                at[k] += w
                raw[k] = par[k] == (1 << w) - 1
                e = k[raw[k]]
                if len(e):
                    par[e] = read.get(at[e], 5)
                    at[e] += 5
        live = coded if t >= most else coded[order[coded] <= t]
        if not len(live):
            continue
        place, k = at[live], par[live]
        word = read.window(place)
        zeros = 32 - np.frexp((word >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        far = np.flatnonzero(zeros >= 32)
        skipped = None
        if len(far):
            skipped = np.zeros(len(live), np.int64)
            while len(far):
                skipped[far] += 32
                word[far] = read.window(place[far] + skipped[far])
                zeros[far] = 32 - np.frexp((word[far] >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
                far = far[(zeros[far] >= 32) & (skipped[far] < 1 << 20)]
        low_bits = ((word << (zeros + 1).astype(np.uint64)) >> one >> (63 - k).astype(np.uint64)).astype(np.int64)
        if skipped is not None:
            zeros = zeros + skipped
        u = (zeros << k) | low_bits
        res, used = (u >> 1) ^ -(u & 1), zeros + 1 + k
        if raw.any():
            e = np.flatnonzero(raw[live])
            for w in np.unique(k[e]).tolist():
                f = e[k[e] == w]
                res[f], used[f] = read.signed(place[f], w), w
        at[live] = place + used
        guess = (coefs[:, live] * x[most + t - 1 - np.arange(most)][:, live]).sum(0) >> shift[live]
        x[most + t, live] = res + guess
    return x[most:].T.astype(np.int32)


def payload_of(text: bytes) -> bytes:
    short = -len(text) % BLOCK if text else BLOCK
    return text + bytes([PAD]) * short


def features(samples: np.ndarray) -> str:
    """Mean, root mean square, share of sign changes and peak of the samples."""
    x = samples.astype(np.int64)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};mean={x.mean():.4f};rms={float((x * x).mean()) ** 0.5:.4f};zcr={turns / max(1, len(x) - 1):.6f};peak={int(np.abs(x).max())}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's payload as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[1], most_bytes):
                raw = utf8_of(batch.column(1))
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(list(map(len, raw)), pa.int64()), pa.array(encode([payload_of(r) for r in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The streams of ``stored``, written to the shared folder."""
    # Rice codes don't repeat, so a dictionary page is of no use to them.
    return written(stored(docs, id_col, text_col), "media", compression="zstd", **{"parquet.enable.dictionary": "false"})


def read_back(media: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """Decode the streams of ``stored`` and digest what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", most_bytes):
                rows = []
                streams = batch.column("media").to_pylist()
                for stream, samples in zip(streams, decode(streams), strict=True):
                    payload = (samples + 128).astype(np.uint8).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(samples)))
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("n_bytes"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, samples: int = PCM_BLOCK, most_bytes: int = 2 << 20) -> DataFrame:
    """The streams of ``media_table`` as a written table of PCM blocks: ``doc_id, block, first_sample,
    n_samples, pcm``, block n of a stream with its samples from ``n * samples`` on, as signed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", most_bytes):
                ids, numbers, firsts, parts = [], [], [], []
                for doc, got in zip(batch.column("doc_id").to_pylist(), decode(batch.column("media").to_pylist()), strict=True):
                    raw = got.astype(np.int8).tobytes()
                    for first in range(0, len(raw), samples):
                        ids.append(doc)
                        numbers.append(first // samples)
                        firsts.append(first)
                        parts.append(raw[first : first + samples])
                longs = [pa.array(v, pa.int64()) for v in (ids, numbers, firsts, list(map(len, parts)))]
                yield pa.record_batch([*longs, pa.array(parts, pa.binary())], ["doc_id", "block", "first_sample", "n_samples", "pcm"])
        tidy()

    rows = media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, first_sample long, n_samples long, pcm binary")
    return written(rows, "pcm", compression="zstd")


def samples_at(blocks: DataFrame, asked: DataFrame, samples: int = PCM_BLOCK) -> DataFrame:
    """``doc_id, sample, value`` of each ``doc_id, sample`` asked for, from the blocks that hold them."""
    wanted = asked.select("doc_id", "sample", F.floor(F.col("sample") / samples).cast("long").alias("block"))
    found = blocks.join(wanted, ["doc_id", "block"]).where(F.col("sample") < F.col("first_sample") + F.col("n_samples"))
    byte = F.conv(F.hex(F.substring("pcm", (F.col("sample") - F.col("first_sample") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.select("doc_id", "sample", F.when(byte > 127, byte - 256).otherwise(byte).alias("value"))


def block_at(stream: bytes, sample: int) -> np.ndarray:
    """The samples of the frame that holds ``sample``, read by its seek point alone."""
    lay = read_layout(stream)
    i = sample // lay["block"]
    size = min(lay["block"], lay["samples"] - i * lay["block"])
    return _frames(np.frombuffer(stream, np.uint8), lay["frames"][i : i + 1], size, lay["bits"])[0]
