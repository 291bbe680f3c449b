"""FLAC in numpy: texts as 8-bit mono streams, written and read many frames at a time.

Frames of many streams are lanes of one array: a step codes or decodes one sample of every lane.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import batches, joined_bytes, materialize, read, tuned

BLOCK = 1024
RATE = 8000
#: Fixed predictors of FLAC (format specification): weights of the samples before, by order. Fixed values.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table8() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c << 1) ^ 0x107 if c & 0x80 else c << 1
        out.append(c)
    return out


def _table16() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        c = np.where(c & 0x8000, (c << 1) ^ 0x18005, c << 1)
    return c.astype(np.uint16)


CRC8, CRC16 = _table8(), _table16()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 8005) of data[start:end] for every pair, a byte of each at a time; longest first."""
    order = np.argsort(starts - ends, kind="stable")
    s, n = starts[order], (ends - starts)[order]
    c = np.zeros(len(s), np.uint16)
    left = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    for i, k in enumerate(left):
        c[:k] = (c[:k] << np.uint16(8)) ^ CRC16[(c[:k] >> np.uint16(8)) ^ data[s[:k] + i]]
    out = np.empty(len(s), np.uint16)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    out, lead = [], 0x3F
    while n > lead:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE - 2 * lead) & 0xFF | n, *reversed(out)])


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Each payload as a FLAC stream of 8-bit mono samples (byte - 128), with a seek point for every frame.

    A frame is coded by the fixed predictor (order 0 to 2) whose Rice code is shortest, or verbatim. An empty payload is a
    stream without frames.
    """
    data = np.frombuffer(b"".join(payloads), np.uint8)
    x = data.astype(np.int32) - 128
    lane_start, lane_n, lane_no, firsts, at = [], [], [], [0], 0
    for p in payloads:
        for f, i in enumerate(range(0, len(p), block)):
            lane_start.append(at + i)
            lane_n.append(min(block, len(p) - i))
            lane_no.append(f)
        at += len(p)
        firsts.append(len(lane_start))
    starts, sizes = np.array(lane_start, np.int64), np.array(lane_n, np.int64)
    frames: list[bytes] = []
    if len(starts):
        inside = (np.arange(len(x), dtype=np.int32) - np.repeat(starts, sizes)).astype(np.int32)
        lane = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        zigzag, sums = [], []
        for order in range(3):
            r = x.copy()
            for j, w in enumerate(FIXED[order]):
                r[j + 1 :] -= w * x[: len(x) - j - 1]
            z = (r << 1) ^ (r >> 31)
            for i in range(order):
                z[(starts + i)[sizes > i]] = 0
            zigzag.append(z)
            sums.append(np.where(sizes > order, np.add.reduceat(z, starts, dtype=np.int64), 1 << 60))
        best = np.argmin(sums, axis=0)
        # Of the parameters about the mean residual, the one with the shortest code.
        count = np.maximum(sizes - best, 1)
        z = np.choose(best[lane], zigzag)
        guess = np.clip(np.frexp(np.min(sums, axis=0) / count)[1] - 1, 0, 9)
        cost, rice = np.full(len(starts), 1 << 60, np.int64), np.zeros(len(starts), np.int64)
        for k in (np.maximum(guess - 1, 0), guess, guess + 1):
            total = np.add.reduceat(z >> k[lane].astype(np.int32), starts, dtype=np.int64) + count * (k + 1) + 8 * best + 10
            better = total < cost
            cost[better], rice[better] = total[better], k[better]
        plain = (cost >= 8 * sizes) | (sizes <= best)
        frames = _frames(x, starts, sizes, lane, inside, z, best, rice, plain, lane_no)
    out = []
    for i, p in enumerate(payloads):
        own = frames[firsts[i] : firsts[i + 1]]
        sizes_ = [len(f) for f in own] or [0]
        info = struct.pack(">HH", block, block) + min(sizes_).to_bytes(3, "big") + max(sizes_).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        points, where = [], 0
        for f, s in enumerate(own):
            points.append(struct.pack(">QQH", f * block, where, min(block, len(p) - f * block)))
            where += len(s)
        seek = b"".join(points)
        meta = bytes([0]) + len(info).to_bytes(3, "big") + info if own else bytes([0x80]) + len(info).to_bytes(3, "big") + info
        # A block's length has 24 bits: of very long streams every nth frame has a seek point.
        step = -(-len(seek) // (18 * 900_000)) or 1
        seek = b"".join(points[::step])
        out.append(b"fLaC" + meta + (bytes([0x83]) + len(seek).to_bytes(3, "big") + seek if own else b"") + b"".join(own))
    return out


def _frames(x, starts, sizes, lane, inside, z, best, rice, plain, lane_no) -> list[bytes]:
    n = len(starts)
    k = np.where(plain, 0, rice)
    order = np.where(plain, 0, best)
    coded = ~plain[lane] & (inside >= order[lane])
    kk = k[lane].astype(np.int32)
    quotient = z >> kk
    # What is written for each sample: zeros, then a code of few bits.
    width = np.where(coded, kk + 1, 8)
    gap = np.where(coded, quotient, 0)
    value = np.where(coded, (1 << kk) | (z & ((1 << kk) - 1)), x & 255)
    head = 8 + np.where(plain, 0, 10)  # subframe header; after warm-up: method, partition order and Rice parameter
    long = (width + gap).astype(np.int64)
    bits = np.add.reduceat(long, starts) + head
    size = (bits + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(size)])
    run = np.cumsum(long) - long
    place = run + gap + (begin[:-1] * 8 + 8 - run[starts])[lane] + np.where(coded, 10, 0)
    rest = ~plain
    at = np.concatenate([place, begin[:-1] * 8, begin[:-1][rest] * 8 + 8 + 8 * order[rest] + 6])
    value = np.concatenate([value, np.where(plain, 1, 8 + order) << 1, k[rest]])
    width = np.concatenate([width, np.full(n, 8), np.full(int(rest.sum()), 4)])
    # Codes share no bit, so bytes are sums; a code of up to 17 bits lies in three of them.
    shifted = value.astype(np.int64) << (24 - (at & 7) - width)
    byte, most = at >> 3, int(begin[-1]) + 2
    total = np.bincount(byte, shifted >> 16, most) + np.bincount(byte + 1, (shifted >> 8) & 255, most) + np.bincount(byte + 2, shifted & 255, most)
    body = total[: int(begin[-1])].astype(np.uint8).tobytes()
    heads = []
    for i in range(n):
        h = bytes([0xFF, 0xF8, 0x70, 0x02]) + coded_number(lane_no[i]) + struct.pack(">H", sizes[i] - 1)
        heads.append(h + bytes([crc8(h)]))
    parts = [heads[i] + body[begin[i] : begin[i + 1]] for i in range(n)]
    whole = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    sums = crc16(whole, ends - [len(p) for p in parts], ends)
    return [p + int(c).to_bytes(2, "big") for p, c in zip(parts, sums, strict=True)]


class Bits:
    """A bit position of every lane, over one array of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        d = self.data.astype(np.uint64)
        self.words = sum(d[i : len(d) - 7 + i] << np.uint64(56 - 8 * i) for i in range(8))  # 64 bits from each byte on

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from a bit on, at the top of 64."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        w = np.asarray(width, np.uint64)
        return np.where(w == 0, np.uint64(0), self.peek(at) >> np.minimum(np.uint64(64) - w, np.uint64(63))).astype(np.int64)


def _signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width, np.int64) - 1)
    return np.where(np.asarray(width) > 0, (v ^ half) - half, 0)


def stream_frames(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]]]:
    """Block size, samples, MD5 and (first byte, first sample, samples) of each frame of an 8-bit mono stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, seek, info = 4, False, b"", b""
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            seek = body
        at += 4 + n
    packed_ = int.from_bytes(info[10:18], "big")
    if (packed_ >> 41) & 7 or (packed_ >> 36) & 31 != 7:
        raise ValueError("only 8-bit mono streams are read")
    total = packed_ & ((1 << 36) - 1)
    points = [struct.unpack_from(">QQH", seek, i) for i in range(0, len(seek), 18)]
    block = struct.unpack(">H", info[:2])[0]
    if len(points) != -(-total // block):
        points, o = [], 0  # not all frames have a seek point: walk from checksum to checksum
        found = 0
        while found < total:
            _, n = _frame_head(stream, at + o)
            points.append((found, o, n))
            found, o = found + n, _next_frame(stream, at + o) - at
    return block, total, info[18:34], [(at + o, s, n) for s, o, n in points]


def _next_frame(stream: bytes, at: int) -> int:
    """Where the frame that starts at a byte ends: the first place whose checksum holds, before a header or the end."""
    c, table = 0, CRC16.tolist()
    for i in range(at, len(stream) - 1):
        if i > at + 6 and c == stream[i] << 8 | stream[i + 1] and (i + 2 == len(stream) or stream[i + 2 : i + 4] in (b"\xff\xf8", b"\xff\xf9")):
            return i + 2
        c = (c << 8 & 0xFFFF) ^ table[(c >> 8) ^ stream[i]]
    raise ValueError(f"the frame at {at} does not end")


def _frame_head(stream: bytes, at: int) -> tuple[int, int]:
    """Bytes of a frame header that starts at a byte, and its samples; its checksum must hold."""
    if stream[at] != 0xFF or stream[at + 1] & 0xFC != 0xF8:
        raise ValueError(f"no frame at {at}")
    code, lead = stream[at + 2] >> 4, stream[at + 4]
    n = 5 + (0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length() - 1)
    if code == 6:
        size, n = stream[at + n] + 1, n + 1
    elif code == 7:
        size, n = int.from_bytes(stream[at + n : at + n + 2], "big") + 1, n + 2
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    n += {12: 1, 13: 2, 14: 2}.get(stream[at + 2] & 15, 0)
    if crc8(stream[at : at + n]) != stream[at + n]:
        raise ValueError(f"frame header at {at} is broken")
    return n + 1, size


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream: frames of all streams are decoded side by side.

    Reads constant, verbatim, fixed and linear-prediction subframes with Rice partitions of either kind. Checksums of
    headers and frames and the MD5 of samples must hold, or ValueError is raised.
    """
    base, heads, sizes, stops, firsts, totals, sums = 0, [], [], [], [0], [], []
    begins = []
    for s in streams:
        _, total, md5, frames = stream_frames(s)
        for i, (at, _, _) in enumerate(frames):
            n, size = _frame_head(s, at)
            begins.append(base + at)
            heads.append(base + at + n)
            sizes.append(size)
            stops.append(base + (frames[i + 1][0] if i + 1 < len(frames) else len(s)))
        firsts.append(len(heads))
        totals.append(total)
        sums.append(md5)
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    if heads:
        begin, stop = np.array(begins), np.array(stops)
        want = data[stop - 2].astype(np.uint16) << np.uint16(8) | data[stop - 1]
        if (crc16(data, begin, stop - 2) != want).any():
            raise ValueError("a frame's checksum does not hold")
        lanes = _lanes(data, np.array(heads, np.int64), np.array(sizes, np.int64))
    out = []
    for i in range(len(streams)):
        own = np.concatenate([lanes[j] for j in range(firsts[i], firsts[i + 1])]) if firsts[i + 1] > firsts[i] else np.zeros(0, np.uint8)
        if len(own) != totals[i] or hashlib.md5(own.tobytes()).digest() != sums[i]:
            raise ValueError("a stream's samples do not have its MD5")
        out.append((own ^ 128).tobytes())
    return out


def _lanes(data: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Samples of each frame as signed bytes, from the first byte of its subframe."""
    bits, n = Bits(data), len(heads)
    rank = np.argsort(-sizes, kind="stable")
    pos, size = heads[rank] * 8, sizes[rank]
    head = bits.take(pos, np.full(n, 8))
    kind = (head >> 1) & 63
    pos = pos + 8
    if (head & 1).any():
        raise ValueError("wasted bits are not used in 8-bit streams")
    constant, plain, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | lpc).all():
        raise ValueError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    most = int(order.max(initial=0))
    out = np.zeros((int(size[0]), n), np.int64)
    warm = np.where(plain, size, np.where(constant, 1, order))
    for i in range(int(warm[~plain].max(initial=0))):  # warm-up samples
        has = (warm > i) & ~plain
        out[i, has] = _signed(bits.take(pos[has], np.full(int(has.sum()), 8)), 8)
        pos[has] += 8
    weights, shift = np.zeros((max(most, 4), n), np.int64), np.zeros(n, np.int64)
    for o, w in enumerate(FIXED):
        for j, v in enumerate(w):
            weights[j, fixed & (order == o)] = v
    if lpc.any():
        at = np.flatnonzero(lpc)
        precision = bits.take(pos[at], np.full(len(at), 4)) + 1
        shift[at] = _signed(bits.take(pos[at] + 4, np.full(len(at), 5)), 5)
        pos[at] += 9
        for j in range(int(order[at].max())):
            has = order[at] > j
            weights[j, at[has]] = _signed(bits.take(pos[at[has]], precision[has]), precision[has])
            pos[at[has]] += precision[has]
    rice = fixed | lpc
    method = np.where(rice, bits.take(pos, np.full(n, 2)), 0)
    parts = np.where(rice, bits.take(pos + 2, np.full(n, 4)), 0)
    pos = pos + np.where(rice, 6, 0)
    wide = np.where(method == 1, 5, 4)
    span = size >> parts
    verbatim = np.flatnonzero(plain)
    for lane in verbatim:
        p = int(pos[lane])
        out[: size[lane], lane] = data[p >> 3 : (p >> 3) + size[lane]].astype(np.int8)
    for lane in np.flatnonzero(constant):
        out[1 : size[lane], lane] = out[0, lane]
    active = np.flatnonzero(rice)  # longest first
    if len(active):
        out[:, active] = _residuals(bits, data, pos[active], size[active], order[active], weights[:most, active], shift[active], wide[active], span[active], out[:, active])
    lanes: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    small = np.ascontiguousarray(out.T.astype(np.int8)).view(np.uint8)
    for j, lane in enumerate(rank):
        lanes[lane] = small[j, : size[j]]
    return lanes


#: Zeros at the top of 16 bits.
ZEROS = np.array([16 - i.bit_length() for i in range(1 << 16)], np.uint64)


def _residuals(bits, data, pos, size, order, weights, shift, wide, span, out) -> np.ndarray:
    """Rice codes and predictions of all lanes; lanes are sorted, longest first."""
    n, most = len(pos), len(weights)
    k, escape = np.zeros(n, np.int64), np.zeros(n, bool)
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    one_part, one = bool((span == size).all()), np.uint64(1)
    for i, m in enumerate(live.tolist()):
        easy = one_part and i > most and not escape.any() if i == most + 1 else one_part and i > most and easy
        if not easy:
            here = np.flatnonzero(order[:m] <= i)
            new = here[(order[here] == i) | (i % span[here] == 0)]
            if len(new):  # a partition starts: its parameter, or the width of raw residuals
                k[new] = bits.take(pos[new], wide[new])
                pos[new] += wide[new]
                escape[new] = k[new] == (1 << wide[new]) - 1
                e = new[escape[new]]
                if len(e):
                    k[e] = bits.take(pos[e], np.full(len(e), 5))
                    pos[e] += 5
            if not len(here):
                continue
        where = slice(0, m) if easy else here
        p, kk = pos[where], k[where].view(np.uint64)
        word = bits.peek(p)
        zeros = ZEROS[(word >> np.uint64(48)).view(np.int64)]
        shifted = (word << (zeros + one)) >> one >> (np.uint64(63) - kk)
        if (zeros == 16).any():  # a long code: counted bit by bit
            for t in np.flatnonzero((zeros == 16) & ~escape[where]):
                q = int(p[t])
                while not (data[q >> 3] >> (7 - (q & 7))) & 1:
                    q += 1
                zeros[t] = q - p[t]
                shifted[t] = bits.take(np.array([q + 1]), k[where][t : t + 1])[0]
        z = ((zeros << kk) | shifted).view(np.int64)
        residual, used = (z >> 1) ^ -(z & 1), (zeros + kk + one).view(np.int64)
        if not easy and escape[here].any():
            raw = _signed(bits.take(p, k[here]), k[here])
            residual, used = np.where(escape[here], raw, residual), np.where(escape[here], k[here], used)
        pos[where] = p + used
        if most:
            guess = weights[0, where] * out[i - 1, where] if i else np.zeros(len(p), np.int64)
            for j in range(1, min(most, i)):
                guess += weights[j, where] * out[i - 1 - j, where]
            residual = residual + (guess >> shift[where])
        out[i, where] = residual
    return out


def padded(text: bytes, unit: int = 64) -> bytes:
    """The bytes with zeros after them, up to a positive multiple of unit."""
    return text + bytes(-len(text) % unit or (0 if text else unit))


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text (null: empty), padded to 64 bytes, as a FLAC stream. Other columns go.

    An empty text is 64 samples. Rows stay, repeated or not, with or without an id; equal texts have equal streams.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(it):
        for b in batches(it, rows=300, size=1 << 20):  # few enough for a processor's cache
            data, at = joined_bytes(b.column(1))
            raw = data.tobytes()
            texts = [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


#: Columns of a stream that its blocks may carry along.
ALSO = {"n_bytes": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string())}


def pcm_blocks(stored: DataFrame, block: int = 65536, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, first_sample, pcm, *also): decoded bytes in blocks of so many samples, each with the offset to seek it by.

    A stream's blocks follow each other in one partition. Every row has its own blocks, also where ids repeat or are null;
    a stream without samples has none, and a null one raises ValueError, as a broken one does.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("first_sample", pa.int64()), ("pcm", pa.binary()), *((c, ALSO[c][1]) for c in also)])

    def cut(it):
        for b in batches(it, rows=4000, size=4 << 20):
            rows = []
            more = zip(*(c.to_pylist() for c in b.columns[2:]), strict=True) if also else [()] * b.num_rows
            if b.column(1).null_count:
                raise ValueError("a stream is null")
            for i, p, x in zip(b.column(0).to_pylist(), decode(b.column(1).to_pylist()), more, strict=True):
                p = bytes(p)
                rows += [(i, j, p[j : j + block], *x) for j in range(0, len(p), block)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stored.select("doc_id", "media", *also).mapInArrow(cut, "doc_id long, first_sample long, pcm binary" + "".join(f", {c} {ALSO[c][0]}" for c in also))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Stream:
    """What is summed up of a stream's blocks, one after the other."""

    def __init__(self, *row) -> None:
        self.row, self.sha, self.tail, self.last = row, hashlib.sha256(), b"", None
        self.samples = self.sum = self.energy = self.crossings = self.peak = 0

    def add(self, p: bytes) -> None:
        self.sha.update(p)
        self.tail = (self.tail + p[-64:])[-64:]
        x = np.frombuffer(p, np.uint8).astype(np.int64) - 128
        low = x < 0
        self.crossings += int((low[1:] != low[:-1]).sum()) + (self.last is not None and self.last != bool(low[0]))
        self.last = bool(low[-1])
        self.samples += len(x)
        self.sum += int(x.sum())
        self.energy += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))

    def result(self) -> tuple:
        i, n, size, sha = self.row
        about = f"samples={self.samples};sum={self.sum};energy={self.energy};crossings={self.crossings};peak={self.peak}"
        return i, n, self.samples, self.sha.hexdigest(), zlib.crc32(self.tail), size, sha, about


def features(stored: DataFrame, block: int = 65536) -> DataFrame:
    """Digests and a short description of each stream, all from the blocks that decoding it gives.

    A row for every stream with samples, repeated or not; media() makes no other.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def look(it) -> Iterator[pa.RecordBatch]:
        stream = None
        for b in it:
            rows = []
            for i, first, p, n, size, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first == 0:
                    if stream:
                        rows.append(stream.result())
                    stream = _Stream(i, n, size, sha)
                stream.add(p)
            if rows:
                yield batch(rows)
        if stream:
            yield batch([stream.result()])

    own = stored.select("doc_id", "media", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return pcm_blocks(own, block, tuple(ALSO)).mapInArrow(look, FEATURES)


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as FLAC in a table of the shared folder, which is read back; the features of what was read.

    A row for each row of documents; null and empty texts are 64 zero bytes.
    """
    tuned(spark)
    # Copies of a text have the same stream, which zstd's window finds again.
    return features(materialize(media(read(spark, sf_dir, "documents")), "media", compression="zstd"))
