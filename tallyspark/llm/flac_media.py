"""Media columns: FLAC streams of 8-bit mono samples, encoded and decoded with arrays.

Encoder: blocks of up to ``BLOCK`` samples; each frame takes the cheapest of a constant, fixed predictors of order 0 to 2
or a quantised linear predictor, with Rice-coded residuals, or plain samples.  STREAMINFO holds the MD5 of the samples, a
SEEKTABLE the sample number and byte offset of every frame, and every frame its CRC-8 and CRC-16.

Decoder: reads any mono 8-bit stream with those subframe types (fixed order up to 4, linear prediction up to 32, Rice
parameters of 4 or 5 bits, escaped partitions, any partition order), checks both CRCs of all frames and the MD5, and
gives PCM blocks with the number of their first sample, so that a range of samples is read from its frames alone.

Rice codes are parsed for thousands of frames side by side: a step takes the next residual of every frame, so the
number of Python steps follows the length of a frame, not of the data.

Defined results: null counts as empty; a payload is padded with zero bytes to a positive multiple of 64; equal payloads
give equal streams; a damaged stream raises ``FlacError`` that names what failed; extra columns are kept, and one with the
name of an output column gives way to it.  Payloads of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.common import slices, utf8, without

BLOCK = 4096
LPC_ORDER, LPC_BITS = 4, 12
#: Samples coded or decoded side by side: bounds a worker's memory.
BATCH = 2 << 20


class FlacError(ValueError):
    """A stream that is no valid FLAC of the supported kind, or that fails a checksum."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        high = (table >> np.uint32(bits - 1)) & np.uint32(1)
        table = ((table << np.uint32(1)) ^ (high * np.uint32(polynomial))) & np.uint32((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_many(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, a byte of each at a time (longest first, so that finished ones fall away)."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    crc = np.zeros(len(at), np.uint32)
    if len(at):
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        for step, n in enumerate(live.tolist()):
            c = crc[:n]
            crc[:n] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ raw[at[:n] + step]]
    out = np.empty(len(at), np.uint32)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in FLAC's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    lead = (0xFF << (8 - size)) & 0xFF
    return bytes([lead | (n >> (6 * (size - 1)))] + [0x80 | ((n >> (6 * i)) & 0x3F) for i in range(size - 2, -1, -1)])


def _frame_header(number: int, n: int) -> bytes:
    """8-bit mono, fixed block size of the stream; the frame's own length in 16 bits."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _coded_number(number) + (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice_cost(z: np.ndarray, n: np.ndarray, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """A good Rice parameter (0 to 12) of each row and its bits: from the mean, or the best of its neighbours too."""
    mean = z.sum(axis=1, dtype=np.int64) / np.maximum(n, 1)
    start = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 12).astype(np.int64)
    best, bits = start, np.full(len(z), np.iinfo(np.int64).max)
    for near in (0, -1, 1) if refine else (0,):
        k = np.clip(start + near, 0, 12)
        cost = (z >> k.astype(np.int32)[:, None]).sum(axis=1, dtype=np.int64) + n * (k + 1)
        best, bits = np.where(cost < bits, k, best), np.minimum(cost, bits)
    return best, bits


def _predictors(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row by the normal equations: coefficients (for the latest sample first), shifts."""
    rows = len(x)
    y = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : max(0, y.shape[1] - lag)], y[:, lag:]) for lag in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    r[:, 0] = r[:, 0] * (1 + 1e-6) + 1.0
    matrix = np.stack([np.stack([r[:, abs(i - j)] for j in range(LPC_ORDER)], axis=1) for i in range(LPC_ORDER)], axis=1)
    solved = np.linalg.solve(matrix, r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(solved).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(top)).astype(np.int64), 0, 14)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(solved * (1 << shift)[:, None]), -limit, limit).astype(np.int32).reshape(rows, LPC_ORDER), shift


@dataclass
class Frames:
    """Frames of several streams, side by side: stream, number within it and samples (rows padded with zeros)."""

    stream: np.ndarray
    number: np.ndarray
    samples: np.ndarray
    lengths: np.ndarray


def _frame_groups(samples: list[np.ndarray], most: int = 384) -> Iterator[Frames]:
    """All frames, in groups of about equal lengths, so that rows need little padding."""
    places = [(min(BLOCK, len(s) - j), i, j) for i, s in enumerate(samples) for j in range(0, len(s), BLOCK)]
    places.sort()
    for a in range(0, len(places), most):
        group = places[a : a + most]
        rows = np.zeros((len(group), group[-1][0]), np.int32)
        for r, (n, i, j) in enumerate(group):
            rows[r, :n] = samples[i][j : j + n]
        yield Frames(np.array([i for _, i, _ in group]), np.array([j // BLOCK for _, _, j in group]), rows, np.array([n for n, _, _ in group], np.int64))


def _residuals(x: np.ndarray, n: np.ndarray) -> tuple[list[tuple[int, np.ndarray, int | np.ndarray]], np.ndarray, np.ndarray]:
    """(order, zigzag residuals with zeros outside the frame, bits in front) of each predictor, and the linear one's."""
    rows, width = x.shape
    outside = np.arange(width)[None] >= n[:, None]
    tries, diff = [], x
    coefficients, shift = _predictors(x, n)
    for order in range(3):
        if order:
            diff = np.diff(diff, axis=1, prepend=np.int32(0))
        tries.append((order, diff, 8 * order + 18))
    total = np.zeros((rows, width), np.int32)
    for j in range(min(LPC_ORDER, width - 1)):
        total[:, j + 1 :] += coefficients[:, j, None] * x[:, : width - j - 1]
    tries.append((LPC_ORDER, x - (total >> shift.astype(np.int32)[:, None]), 8 * LPC_ORDER + 27 + LPC_ORDER * LPC_BITS))
    out = []
    for order, residual, head in tries:
        z = _zigzag(residual)
        z[outside] = 0
        z[:, :order] = 0
        out.append((order, z, head))
    return out, coefficients, shift


def _encode_frames(f: Frames) -> list[bytes]:
    """Frames of about equal length: all predictors at once, the cheapest written."""
    x, n = f.samples, f.lengths
    rows, width = x.shape
    cols = np.arange(width)
    tries, coefficients, shift = _residuals(x, n)
    never = np.iinfo(np.int64).max
    costs = np.stack([np.where(n > order, _rice_cost(z, n - order, False)[1] + head, never) for order, z, head in tries])
    kind = np.argmin(costs, axis=0)
    plain = costs[kind, np.arange(rows)] >= 8 * n + 8
    constant = (x.max(axis=1, where=cols[None] < n[:, None], initial=-128) == x[:, 0]) & (x.min(axis=1, where=cols[None] < n[:, None], initial=127) == x[:, 0])
    out: list[bytes] = [b""] * rows
    for i in np.flatnonzero(constant | plain):
        own = x[i, : n[i]]
        body = bytes([0x00, int(own[0]) & 0xFF]) if constant[i] else b"\x02" + own.astype(np.int8).tobytes()
        out[i] = _frame_header(int(f.number[i]), int(n[i])) + body
    for o, (order, z, _) in enumerate(tries):
        pick = np.flatnonzero((kind == o) & ~constant & ~plain)
        if not len(pick):
            continue
        z = z[pick]
        k, _ = _rice_cost(z, n[pick] - order, True)
        coded = (cols[None] >= order) & (cols[None] < n[pick, None])
        size = (z >> k.astype(np.int32)[:, None]) + (k + 1).astype(np.int32)[:, None]
        size[~coded] = 0
        heads = []
        for at, i in enumerate(pick.tolist()):
            head = "".join(f"{v:08b}" for v in bytes([(8 | order) << 1 if o < 3 else (31 + order) << 1]) + x[i, :order].astype(np.int8).tobytes())
            if o == 3:
                head += f"{LPC_BITS - 1:04b}{int(shift[i]):05b}" + "".join(f"{int(c) & ((1 << LPC_BITS) - 1):0{LPC_BITS}b}" for c in coefficients[i])
            heads.append(head + f"000000{int(k[at]):04b}")
        ends = np.cumsum(size, axis=1, dtype=np.int64) + np.array([len(h) for h in heads])[:, None]
        base = np.concatenate([[0], np.cumsum((ends[:, -1] + 7) // 8)])
        # every code ends with its stop bit and k low bits: at most 13 bits, so three bytes at any position
        last = (ends + 8 * base[:-1, None] - 1)[coded]
        depth = np.broadcast_to(k.astype(np.int32)[:, None], coded.shape)[coded]
        one = np.int32(1)
        code = ((one << depth) | (z[coded] & ((one << depth) - one))) << (7 - (last & 7)).astype(np.int32)
        byte, total = last >> 3, int(base[-1])
        body = np.bincount(byte, code & 255, total) + np.bincount(np.maximum(byte - 1, 0), (code >> 8) & 255, total) + np.bincount(np.maximum(byte - 2, 0), code >> 16, total)
        body = body.astype(np.uint8)
        for i, h in enumerate(heads):
            whole = -(-len(h) // 8)
            body[base[i] : base[i] + whole] |= np.frombuffer(int(h.ljust(8 * whole, "0"), 2).to_bytes(whole, "big"), np.uint8)
        packed = body.tobytes()
        for i, row in enumerate(pick.tolist()):
            out[row] = _frame_header(int(f.number[row]), int(n[row])) + packed[base[i] : base[i + 1]]
    raw = np.frombuffer(b"".join(out), np.uint8)
    ends = np.cumsum([len(b) for b in out]).astype(np.int64)
    starts = ends - np.array([len(b) for b in out], np.int64)
    return [b + int(c).to_bytes(2, "big") for b, c in zip(out, crc16_many(raw, starts, ends), strict=True)]


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """A FLAC stream of each (non-empty) payload; bytes are unsigned 8-bit samples, stored less 128."""
    samples = [np.frombuffer(p, np.uint8).astype(np.int32) - 128 for p in payloads]
    if not samples:
        return []
    done: list[dict[int, bytes]] = [{} for _ in payloads]
    for f in _frame_groups(samples):
        for i, j, frame in zip(f.stream.tolist(), f.number.tolist(), _encode_frames(f), strict=True):
            done[i][j] = frame
    out = []
    for s, frames in zip(samples, done, strict=True):
        frames = [frames[j] for j in range(len(frames))]
        sizes = [len(x) for x in frames]
        block = min(BLOCK, max(16, len(s)))
        packed = (rate << 44) | (0 << 41) | (7 << 36) | len(s)
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(s.astype(np.int8).tobytes()).digest()
        seek, at = [], 0
        for j, size in enumerate(sizes):
            seek.append((j * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(s) - j * BLOCK).to_bytes(2, "big"))
            at += size
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames))
    return out


@dataclass
class Stream:
    """What a stream's head says: samples, MD5, first byte of the frames, seek points (sample, byte, samples)."""

    total: int
    md5: bytes
    first: int
    seek: list[tuple[int, int, int]]


def read_head(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, total, md5, seek, last = 4, -1, b"", [], False
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata is cut off")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise FlacError("only mono streams of 8 bits are read")
            total, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            for i in range(0, size, 18):
                sample = int.from_bytes(body[i : i + 8], "big")
                if sample != (1 << 64) - 1:
                    seek.append((sample, int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")))
    if total < 0:
        raise FlacError("no STREAMINFO")
    return Stream(total, md5, at, seek)


class _Bits:
    """Bit reads at one position of each of many lanes in one byte array."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw) + 8]
        self.words = np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 valid bits from each position, left-aligned."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.int64), at.shape)
        return np.where(n > 0, self.peek(at) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zero bits in front of the next one."""
        count = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            high = (self.peek(at[open_] + count[open_]) >> np.uint64(32)).astype(np.float64)
            zeros = np.where(high > 0, 32 - np.frexp(high)[1], 32)
            count[open_] += zeros
            open_ = open_[high == 0]
            if len(open_) and int((at[open_] + count[open_]).max()) >= 8 * (len(self.words) - 8):
                raise FlacError("a residual runs beyond the data")
        return count


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return (v ^ half) - half


#: Coefficients of the fixed predictors of order 0 to 4, the latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _decode_lanes(bits: _Bits, at: np.ndarray, n: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one subframe a lane (rows padded), and the bit position behind each."""
    lanes, width = len(at), int(n.max())
    out = np.zeros((lanes, width + 32), np.int32)  # 32 columns of history in front
    kind, wasted = bits.take(at + 1, 6), bits.take(at + 7, 1)
    if wasted.any() or bits.take(at, 1).any():
        raise FlacError("a subframe header is not supported")
    at = at + 8
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not ((kind <= 1) | fixed | linear).all():
        raise FlacError("a reserved subframe type")
    for i in np.flatnonzero(kind == 0):
        out[i, 32 : 32 + n[i]] = np.int8(bits.take(at[i : i + 1], 8)[0])
        at[i] += 8
    for i in np.flatnonzero(kind == 1):
        skip, first = int(at[i]) & 7, int(at[i]) >> 3
        if skip:
            out[i, 32 : 32 + n[i]] = _signed(bits.take(at[i] + 8 * np.arange(n[i]), 8), 8)
        else:
            out[i, 32 : 32 + n[i]] = raw[first : first + n[i]].view(np.int8)
        at[i] += 8 * n[i]
    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
        if (order > n)[rows].any():
            raise FlacError("a predictor is longer than its frame")
        for j in range(int(order[rows].max())):
            use = rows[order[rows] > j]
            out[use, 32 + j] = _signed(bits.take(at[use], 8), 8)
            at[use] += 8
        depth = int(order[rows].max())
        weight, shift = np.zeros((lanes, max(1, depth)), np.int32), np.zeros(lanes, np.int32)
        for i in rows[fixed[rows]]:
            weight[i, : order[i]] = FIXED[order[i]]
        lin = rows[linear[rows]]
        precision = bits.take(at[lin], 4) + 1
        shift[lin] = _signed(bits.take(at[lin] + 4, 5), 5)
        at[lin] += 9
        if (shift[lin] < 0).any() or (precision == 16).any():
            raise FlacError("an invalid linear predictor")
        for j in range(int(order[lin].max()) if len(lin) else 0):
            use = order[lin] > j
            weight[lin[use], j] = _signed(bits.take(at[lin[use]], precision[use]), precision[use])
            at[lin[use]] += precision[use]
        method = bits.take(at[rows], 2)
        if (method > 1).any():
            raise FlacError("a reserved residual coding")
        field = np.zeros(lanes, np.int64)
        field[rows] = 4 + method
        split = np.zeros(lanes, np.int64)
        split[rows] = bits.take(at[rows] + 2, 4)
        at[rows] += 6
        part = np.maximum(n >> split, 1)
        if ((n % (1 << split))[rows] != 0).any() or (part < order)[rows].any():
            raise FlacError("partitions do not fit the frame")
        # longest first: the lanes still running are a prefix
        rows = rows[np.argsort(-n[rows], kind="stable")]
        live = np.searchsorted(-n[rows], -np.arange(1, width + 1), side="right")
        pos, k, escape = at[rows], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        w, sh, o, f, p = weight[rows], shift[rows], order[rows], field[rows], part[rows]
        any_split, x = bool((split[rows] > 0).any()), np.ascontiguousarray(out[rows].T)
        for t in range(width):
            m = int(live[t])
            if t <= depth or any_split:
                opens = np.flatnonzero((o[:m] == t) | ((t > o[:m]) & (t % p[:m] == 0)))
                if len(opens):
                    k[opens] = bits.take(pos[opens], f[opens])
                    pos[opens] += f[opens]
                    esc = opens[k[opens] == (1 << f[opens]) - 1]
                    escape[opens] = 0
                    if len(esc):
                        escape[esc] = bits.take(pos[esc], 5) + 1
                        pos[esc] += 5
            value = bits.peek(pos[:m])
            high = (value >> np.uint64(32)).astype(np.float64)
            q = 32 - np.frexp(high)[1].astype(np.int64)
            q[high == 0] = 64
            far = q + 1 + k[:m] > 56
            kk = k[:m]
            low = ((value << (np.minimum(q, 62) + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
            z = (np.minimum(q, 62) << kk) | low.astype(np.int64)
            if far.any():
                slow = np.flatnonzero(far)
                q[slow] = bits.unary(pos[slow])
                z[slow] = (q[slow] << kk[slow]) | bits.take(pos[slow] + q[slow] + 1, kk[slow])
            r = (z >> 1) ^ -(z & 1)
            step = q + 1 + kk
            if escape.any():
                esc = np.flatnonzero(escape[:m])
                raw_bits = escape[esc] - 1
                r[esc] = np.where(raw_bits > 0, _signed(bits.take(pos[esc], raw_bits), np.maximum(raw_bits, 1)), 0)
                step[esc] = raw_bits
            if t < depth:
                warm = t < o[:m]
                r, step = np.where(warm, 0, r), np.where(warm, 0, step)
            pos[:m] += step
            if depth:
                guess = w[:m, 0] * x[t + 31, :m]
                for j in range(1, depth):
                    guess = guess + w[:m, j] * x[t + 31 - j, :m]
                r = r + (guess >> sh[:m])
                if t < depth:
                    r = np.where(warm, x[t + 32, :m], r)
            elif t < 1:
                r = np.where(o[:m] > 0, x[t + 32, :m], r)
            x[t + 32, :m] = r
        out[rows], at[rows] = x.T, pos
    return out[:, 32:], at


def _frame_at(data: np.ndarray, at: int) -> tuple[int, int, int]:
    """(number, samples, header bytes) of the frame that starts at a byte; checks the header's CRC-8."""
    head = data[at : at + 16].tobytes()
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    size_code, lead = head[2] >> 4, head[4]
    extra = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead if not extra else lead & ((1 << (6 - extra)) - 1)
    for b in head[5 : 5 + extra]:
        number = number << 6 | b & 0x3F
    end = 5 + extra
    if size_code == 6:
        n, end = head[end] + 1, end + 1
    elif size_code == 7:
        n, end = int.from_bytes(head[end : end + 2], "big") + 1, end + 2
    else:
        n = {1: 192}.get(size_code, 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8))
    if head[end] != crc8(head[:end]):
        raise FlacError(f"CRC-8 of the frame at byte {at} fails")
    return number, n, end + 1


def scan_frames(data: np.ndarray, first: int) -> list[tuple[int, int, int]]:
    """(first sample, byte behind the metadata, samples) of every frame of a stream without a seek table: a frame ends where
    the next header stands whose CRC-8 holds and whose number follows, and its own CRC-16 holds."""
    marks = np.flatnonzero((data[first:-1] == 0xFF) & (data[first + 1 :] & 0xFE == 0xF8)) + first
    out: list[tuple[int, int, int]] = []
    at, sample = first, 0
    while at < len(data):
        number, n, _ = _frame_at(data, at)
        out.append((sample, at - first, n))
        follow = 0
        for c in marks[np.searchsorted(marks, at, side="right") :].tolist():
            try:
                following = _frame_at(data, c)[0]
            except (FlacError, IndexError):
                continue
            if following in (number + 1, sample + n) and int(crc16_many(data, np.array([at]), np.array([c - 2]))[0]) == int(data[c - 2]) << 8 | int(data[c - 1]):
                follow = c
                break
        at, sample = follow or len(data), sample + n
    return out


@dataclass
class PcmBlock:
    """Decoded samples of one frame (unsigned bytes) and the stream's number of the first one."""

    sample: int
    pcm: bytes


def decode(streams: list[bytes], spans: list[tuple[int, int]] | None = None) -> list[list[PcmBlock]]:
    """PCM blocks of each stream; with ``spans`` (first sample, end) only of the frames that hold them.

    Frames are found by the seek table, or one after the other where a stream has none; every frame's CRC-8 and CRC-16 are verified, and the MD5 of whole streams."""
    heads = [read_head(s) for s in streams]
    owner, first, end, sample, n, skip = [], [], [], [], [], []
    base = 0
    for i, (s, h) in enumerate(zip(streams, heads, strict=True)):
        data = np.frombuffer(s, np.uint8)
        points = h.seek if h.seek or not h.total else scan_frames(data, h.first)
        ends = [b for _, b, _ in points[1:]] + [len(s) - h.first]
        for (at, byte, size), stop in zip(points, ends, strict=False):
            if spans and (at >= spans[i][1] or at + size <= spans[i][0]):
                continue
            _, have, head = _frame_at(data, h.first + byte)
            if have != size:
                raise FlacError(f"the frame at sample {at} has {have} samples, the seek table {size}")
            owner.append(i), first.append(base + h.first + byte), end.append(base + h.first + stop), sample.append(at), n.append(have), skip.append(head)
        base += len(s)
    out: list[list[PcmBlock]] = [[] for _ in streams]
    if owner:
        raw = np.frombuffer(b"".join(streams), np.uint8)
        a, b, count = np.array(first), np.array(end), np.array(n)
        told = raw[b - 2].astype(np.uint32) << np.uint32(8) | raw[b - 1]
        if (bad := np.flatnonzero(crc16_many(raw, a, b - 2) != told)).size:
            raise FlacError(f"CRC-16 of {bad.size} frames fails")
        values, stop = _decode_lanes(_Bits(raw), (a + np.array(skip)) * 8, count, raw)
        if ((stop + 7) // 8 != b - 2).any():
            raise FlacError("a frame ends elsewhere than its data")
        pcm = (values + 128).astype(np.uint8)
        for k, i in enumerate(owner):
            out[i].append(PcmBlock(sample[k], pcm[k, : count[k]].tobytes()))
    if not spans:
        for h, blocks in zip(heads, out, strict=True):
            whole = b"".join(x.pcm for x in blocks)
            if len(whole) != h.total or hashlib.md5((np.frombuffer(whole, np.uint8) ^ np.uint8(128)).tobytes()).digest() != h.md5:
                raise FlacError("the MD5 of the samples fails")
    return out


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def to_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None, media: str = "media") -> DataFrame:
    """``keep`` columns (all others by default) with n_bytes of each text's UTF-8 and its padded payload as a FLAC stream."""
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, [media, "n_bytes"])
    schema = docs.select(*keep).schema.add("n_bytes", "long").add(media, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(text))
            for i, j in slices(offsets, BATCH):
                own = [raw[p:q].tobytes() for p, q in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([len(x) for x in own], pa.int64()), pa.array(encode([padded(x) for x in own]), pa.binary())], [f.name for f in schema])

    return docs.select(*keep, text).mapInArrow(run, schema)


def feature(pcm: np.ndarray) -> str:
    """Level features of 8-bit samples: mean, root mean square, peak and crossings of the middle."""
    x = pcm.astype(np.int64) - 128
    return f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={int((np.diff(x < 0) != 0).sum())}"


def read_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """Every column but ``media`` with what the stored stream gives when read back: payload_bytes, payload_sha256, tail_crc32
    (of the last 64 samples), media_bytes, media_sha256, feature and ``blocks`` (number of the
    first sample and count of samples of every PCM block).  Streams without samples give empty blocks."""
    keep = without([c for c in stored.columns if c != media], ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks"])
    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks array<struct<sample:long,samples:int>>"
    schema = stored.select(*keep).schema
    for f in stored.sparkSession.createDataFrame([], new).schema:
        schema = schema.add(f)
    block = pa.list_(pa.struct([("sample", pa.int64()), ("samples", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = utf8(b.column(media))
            for i, j in slices(offsets, BATCH):
                part = b.slice(i, j - i)
                streams = part.column(media).to_pylist()
                blocks = decode(streams)
                payloads = [b"".join(x.pcm for x in own) for own in blocks]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(k) for k in keep), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    pa.array([feature(np.frombuffer(p, np.uint8)) if p else "" for p in payloads], pa.string()),
                    pa.array([[{"sample": x.sample, "samples": len(x.pcm)} for x in own] for own in blocks], block)], [f.name for f in schema])

    return stored.select(*keep, media).mapInArrow(run, schema)


def pcm_blocks(stored: DataFrame, media: str = "media", first: int | None = None, end: int | None = None) -> DataFrame:
    """One row a PCM block: every column but ``media`` with ``sample`` (number of the block's first sample in its stream) and
    ``pcm`` (unsigned 8-bit samples).  With ``first`` and ``end`` only the blocks that hold samples of that range are read
    and decoded, found by the seek table."""
    keep = without([c for c in stored.columns if c != media], ["sample", "pcm"])
    schema = stored.select(*keep).schema.add("sample", "long").add("pcm", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = utf8(b.column(media))
            for i, j in slices(offsets, BATCH):
                part = b.slice(i, j - i)
                streams = part.column(media).to_pylist()
                own = decode(streams, None if first is None and end is None else [(first or 0, end if end is not None else 1 << 62)] * len(streams))
                rows = pa.array([k for k, blocks in enumerate(own) for _ in blocks], pa.int64())
                flat = [x for blocks in own for x in blocks]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in keep), pa.array([x.sample for x in flat], pa.int64()), pa.array([x.pcm for x in flat], pa.binary())], [f.name for f in schema])

    return stored.select(*keep, media).mapInArrow(run, schema)
