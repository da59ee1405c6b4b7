"""FLAC media columns: texts' bytes as 8-bit mono samples, encoded and decoded by whole batches of frames.

Encoding chooses for each frame the fixed or the linear predictor (Levinson's recursion, quantised) that needs fewer
bits, and a Rice parameter, and sets all code bits of a batch of frames at once. A stream has a seek point for every frame, so that frames can be found and decoded
independently. Decoding walks all frames of a batch in step: sample i of every frame is read in one round of
array operations (unary part by the next set bit, remainder from a 32-bit window); predictors are then
undone along the sample axis. Header CRC-8 and frame CRC-16 are checked for every frame. What comes out is PCM in blocks
with their first samples. The decoder reads 8-bit mono streams with a seek table for every frame and a fixed block size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textops import chunks

BLOCK = 1024
RATE = 8000
PAD = 64
#: Frames that are encoded or decoded together; with BLOCK this bounds the memory of a step.
FRAMES = 1024
#: Linear predictors: order, bits of a coefficient, and the shift that undoes its scale.
ORDER, PRECISION, SHIFT = 4, 12, 9


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint32)
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out[b] = r
    return out


_CRC8 = _crc_table(8, 0x07)
_CRC16 = _crc_table(16, 0x8005)
_BY_DISTANCE: list[np.ndarray] = [_CRC16.astype(np.uint16)]


def _crc16_tables(n: int) -> np.ndarray:
    """Row d, column b: the CRC-16 of byte b followed by d zero bytes; a CRC is the exclusive or of its bytes' entries."""
    if n > 1 << 13:
        raise ValueError("a frame is longer than this codec's limit")
    have = _BY_DISTANCE[0].reshape(-1, 256)
    if len(have) < n:
        rows = [*have]
        while len(rows) < max(n, BLOCK + 64):
            last = rows[-1].astype(np.uint32)
            rows.append((((last << 8) & 0xFFFF) ^ _CRC16[last >> 8]).astype(np.uint16))
        have = _BY_DISTANCE[0] = np.array(rows)
    return have


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each of several runs of bytes, which lie in order and touch or leave gaps."""
    sizes = ends - starts
    tables = _crc16_tables(int(sizes.max()) + 1 if len(sizes) else 1)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = inside + np.repeat(starts, sizes)
    distance = np.repeat(sizes, sizes) - 1 - inside
    return np.bitwise_xor.reduceat(tables[distance, data[at]], np.cumsum(sizes) - sizes)


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's extended UTF-8: (bytes, 7 columns; lengths)."""
    sizes = np.searchsorted([0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000], values, "right") + 1
    out = np.zeros((len(values), 7), np.uint8)
    for n in np.unique(sizes):
        rows = sizes == n
        v = values[rows]
        if n == 1:
            out[rows, 0] = v
            continue
        for j in range(n - 1, 0, -1):
            out[rows, j] = 0x80 | (v & 0x3F)
            v = v >> 6
        out[rows, 0] = ((0xFF00 >> n) & 0xFF) | v
    return out, sizes


def _scatter(out: np.ndarray, at: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    for to, begin, n in zip(at.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        out[to : to + n] = flat[begin : begin + n]


def _predictors(x: np.ndarray, sizes: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of ORDER: (ORDER x frames, whether a frame's coefficients fit their bits)."""
    f = x.astype(np.float64)
    r = []
    for k in range(ORDER + 1):  # sums of integers, exact
        product = f.copy()
        product[k:] *= f[: len(f) - k]
        product[place < k] = 0
        r.append(np.add.reduceat(product, starts))
    a, error = [], r[0] + 1.0
    for i in range(ORDER):
        rest = r[i + 1].copy()
        for j in range(i):
            rest -= a[j] * r[i - j]
        k = rest / error
        a = [a[j] - k * a[i - 1 - j] for j in range(i)] + [k]
        error = np.maximum(error * (1 - k * k), 1e-3)
    q = np.rint(np.array(a) * (1 << SHIFT))
    fits = (np.abs(q) < 1 << (PRECISION - 1)).all(axis=0)
    return np.where(fits, q, 0).astype(np.int64), fits


def _rice(rest: np.ndarray, coded: np.ndarray, sizes: np.ndarray, starts: np.ndarray, order: np.ndarray):
    """(unsigned residuals, Rice parameter of each frame, bits of each code, bits of each frame)."""
    u = np.where(coded, (rest << 1) ^ (rest >> 31), 0)
    mean = np.add.reduceat(u, starts) / np.maximum(sizes - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64), 0, 14)
    each = np.where(coded, (u >> np.repeat(k, sizes)) + 1 + np.repeat(k, sizes), 0)
    return u, k, each, np.add.reduceat(each, starts)


def encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, lpc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frames of consecutive runs of 8-bit samples: (their bytes, byte offsets, one more than frames).

    Without ``lpc`` only fixed predictors are tried.
    """
    x = samples.astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    best, order = np.add.reduceat(np.abs(x), starts), np.zeros(len(sizes), np.int64)
    rest, step = x.copy(), x
    for k in (1, 2):
        before = step
        step = np.empty_like(before)
        step[0], step[1:] = 0, before[1:] - before[:-1]
        step[place < k] = 0
        cost = np.add.reduceat(np.abs(step), starts)
        better = cost + 8 * k < best
        best, order = np.where(better, cost, best), np.where(better, k, order)
        rows = np.repeat(better, sizes)
        rest[rows] = step[rows]
    coded = place >= np.repeat(order, sizes)
    u, k, bits_each, bits = _rice(rest, coded, sizes, starts, order)
    linear, coefficients = np.zeros(len(sizes), bool), np.zeros((ORDER, len(sizes)), np.int64)
    if lpc:
        coefficients, fits = _predictors(x, sizes, starts, place)
        said = np.zeros(len(x), np.int64)
        for j in range(ORDER):
            said[j + 1 :] += (np.repeat(coefficients[j], sizes)[j + 1 :]) * x[: -j - 1]
        other = (x - (said >> SHIFT)).astype(np.int32)
        late = place >= ORDER
        found = _rice(other, late, sizes, starts, np.full(len(sizes), ORDER))
        linear = fits & (sizes > ORDER) & (found[3] + ORDER * 8 + 9 + ORDER * PRECISION < bits + order * 8)
        rows = np.repeat(linear, sizes)
        u, bits_each, coded = np.where(rows, found[0], u), np.where(rows, found[2], bits_each), np.where(rows, late, coded)
        k, bits, order = np.where(linear, found[1], k), np.where(linear, found[3], bits), np.where(linear, ORDER, order)
    kk = np.repeat(k, sizes)
    q = u >> kk
    number, number_size = _numbers(numbers)
    head = 4 + number_size + 2 + 1  # with CRC-8
    extra = np.where(linear, 9 + ORDER * PRECISION, 0)  # precision, shift, coefficients
    intro = head * 8 + 8 + order * 8 + extra + 10
    plain = intro + bits >= head * 8 + 8 + sizes * 8
    body = np.where(plain, head + 1 + sizes, (intro + bits + 7) // 8)
    ends = np.cumsum(body + 2)
    at = ends - body - 2
    # all Rice codes as single bits
    raw = np.zeros(int(ends[-1]) * 8, np.uint8)
    use = coded & ~np.repeat(plain, sizes)
    offset = np.cumsum(bits_each) - bits_each
    where = (offset + np.repeat(at * 8 + intro - offset[starts], sizes) + q)[use]
    raw[where] = 1
    uu, ku = u[use], kk[use]
    for j in range(int(ku.max()) if len(ku) else 0):
        has = ku > j
        raw[where[has] + 1 + j] = (uu[has] >> (ku[has] - 1 - j)) & 1
    rice = ~plain
    for j in range(4):
        raw[(at * 8 + intro - 4 + j)[rice]] = (k[rice] >> (3 - j)) & 1
    some = np.flatnonzero(rice & linear)
    first = at[some] * 8 + head[some] * 8 + 8 + ORDER * 8
    fields = [(4, np.full(len(some), PRECISION - 1)), (5, np.full(len(some), SHIFT)), *((PRECISION, c[some]) for c in coefficients)]
    for width, values in fields:
        for j in range(width):
            raw[first + j] = (values >> (width - 1 - j)) & 1
        first = first + width
    out = np.packbits(raw)
    out[at], out[at + 1], out[at + 2], out[at + 3] = 0xFF, 0xF8, 0x70, 0x02
    for j in range(7):
        rows = number_size > j
        out[at[rows] + 4 + j] = number[rows, j]
    after = at + 4 + number_size
    out[after], out[after + 1] = (sizes - 1) >> 8, (sizes - 1) & 0xFF
    crc = np.zeros(len(sizes), np.uint32)
    for j in range(int(head.max()) - 1):
        rows = head - 1 > j
        crc[rows] = _CRC8[crc[rows] ^ out[at[rows] + j]]
    out[after + 2] = crc
    sub = at + head
    out[sub] = np.where(plain, 1, np.where(linear, 0x20 + order - 1, 8 + order)) << 1
    for j in range(ORDER):
        rows = rice & (order > j)
        out[sub[rows] + 1 + j] = x[starts[rows] + j] & 0xFF
    if plain.any():
        _scatter(out, sub[plain] + 1, (x & 0xFF).astype(np.uint8), starts[plain], sizes[plain])
    code = crc16(out, at, ends - 2)
    out[ends - 2], out[ends - 1] = code >> 8, code & 0xFF
    return out, np.append(at, ends[-1])


def encode(flat: np.ndarray, offsets: np.ndarray, lpc: bool = True) -> list[bytes]:
    """A FLAC stream for each row of bytes; rows are not empty."""
    docs = np.diff(offsets)
    per = -(-docs // BLOCK)
    first = np.cumsum(per) - per
    number = np.arange(per.sum()) - np.repeat(first, per)
    sizes = np.minimum(BLOCK, np.repeat(docs, per) - number * BLOCK)
    starts = np.repeat(offsets[:-1], per) + number * BLOCK
    samples = (flat ^ 0x80).view(np.int8)
    pieces, lengths = [], []
    for a in range(0, len(sizes), FRAMES):
        part = slice(a, a + FRAMES)
        end = starts[part][-1] + sizes[part][-1]
        data, at = encode_frames(samples[starts[a] : end], sizes[part], number[part], lpc)
        pieces.append(data)
        lengths.append(np.diff(at))
    body, lengths = np.concatenate(pieces), np.concatenate(lengths)
    at = np.cumsum(lengths) - lengths
    out = []
    for i in range(len(docs)):
        a, b = first[i], first[i] + per[i]
        begin, end = at[a], at[b - 1] + lengths[b - 1]
        n = int(docs[i])
        md5 = hashlib.md5(samples[offsets[i] : offsets[i + 1]].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths[a:b].min()).to_bytes(3) + int(lengths[a:b].max()).to_bytes(3)
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8) + md5
        points = np.empty(b - a, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        points["sample"], points["byte"], points["n"] = number[a:b] * BLOCK, at[a:b] - begin, sizes[a:b]
        table_ = points.tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(table_).to_bytes(3) + table_ + body[begin:end].tobytes())
    return out


def seek_table(stream: bytes) -> tuple[int, int, np.ndarray, bytes]:
    """(samples, first byte of the frames, seek points, MD5 of the samples) from a stream's metadata."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, points, total, md5 = 4, None, 0, b""
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        block = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            total, md5 = int.from_bytes(block[10:18]) & ((1 << 36) - 1), block[18:34]
        elif kind & 0x7F == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        at += 4 + size
        if kind & 0x80:
            break
    if points is None:
        raise ValueError("the stream has no seek table")
    return total, at, points, md5


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Samples of frames that lie in order, one after the other; ValueError on a checksum or header that does not hold."""
    n = len(starts)
    stored = data[ends - 2].astype(np.uint16) << 8 | data[ends - 1]
    if (crc16(data, starts, ends - 2) != stored).any():
        raise ValueError("a frame's CRC-16 does not hold")
    if ((data[starts] != 0xFF) | (data[starts + 1] != 0xF8) | (data[starts + 2] != 0x70) | (data[starts + 3] != 0x02)).any():
        raise ValueError("a frame is not 8-bit mono with a 16-bit block size")
    lead = data[starts + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    after = starts + 4 + number_size
    sizes = (data[after].astype(np.int64) << 8 | data[after + 1]) + 1
    if (sizes != expected).any():
        raise ValueError("a frame's block size differs from its seek point")
    crc = np.zeros(n, np.uint32)
    for j in range(int((after + 2 - starts).max())):
        rows = after + 2 - starts > j
        crc[rows] = _CRC8[crc[rows] ^ data[starts[rows] + j]]
    if (crc != data[after + 2]).any():
        raise ValueError("a header's CRC-8 does not hold")
    sub = after + 3
    kind = data[sub] >> 1
    out = np.zeros((n, int(sizes.max())), np.int64)
    column = np.arange(out.shape[1])
    valid = column < sizes[:, None]
    plain, flat_ = kind == 1, kind == 0
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(plain | flat_ | fixed | linear)).any():
        raise ValueError("a subframe has a reserved type")
    if plain.any():
        rows = np.flatnonzero(plain)
        inside = column[None, :] < sizes[rows, None]
        out[rows] = np.where(inside, data[np.where(inside, sub[rows, None] + 1 + column, 0)].view(np.int8), 0)
    out[flat_] = data[sub[flat_] + 1].view(np.int8)[:, None]
    rice = np.flatnonzero(fixed | linear)
    if len(rice):
        order = np.where(fixed, kind - 8, kind - 31).astype(np.int64)[rice]
        rank = np.argsort(-sizes[rice], kind="stable")
        rice, order = rice[rank], order[rank]
        size = sizes[rice]
        bits = np.unpackbits(data)
        ones = np.append(np.flatnonzero(bits), len(bits)).astype(np.int32)
        before = np.cumsum(bits, dtype=np.int32) - bits  # set bits before each place
        wide = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64)
        words = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]

        def take(p, k):
            return (words[p >> 3] >> (32 - (p & 7) - k)) & ((1 << k) - 1)

        warm = np.zeros((len(rice), 32), np.int64)
        for j in range(int(order.max())):
            rows = order > j
            warm[rows, j] = data[sub[rice[rows]] + 1 + j].view(np.int8)
        p = (sub[rice] + 1 + order) * 8
        shift, coefficients = np.zeros(len(rice), np.int64), np.zeros((len(rice), 32), np.int64)
        general = linear[rice]
        if general.any():
            precision = take(p, 4) + 1
            shift = take(p + 4, 5)
            p = p + np.where(general, 9, 0)
            for j in range(int(order[general].max())):
                rows = np.flatnonzero(general & (order > j))
                value = take(p[rows], precision[rows])
                coefficients[rows, j] = np.where(value >> (precision[rows] - 1), value - (1 << precision[rows]), value)
                p[rows] += precision[rows]
        method, parts = take(p, 2), take(p + 2, 4)
        if (method > 1).any():
            raise ValueError("a residual has a reserved coding method")
        width = 4 + method
        p = p + 6
        run = size >> parts
        k = np.zeros(len(rice), np.int64)
        codes = np.zeros((out.shape[1], len(rice)), np.int32)
        uneven = (parts > 0).any()
        lowest, highest = int(order.min()), int(order.max())
        for i in range(lowest, out.shape[1]):
            m = int(np.searchsorted(-size, -i, "left"))  # frames longer than i come first
            begin = i == lowest or i <= highest or uneven
            if begin:
                new = (i == order[:m]) | ((i > order[:m]) & (i % run[:m] == 0))
                if new.any():
                    k[:m] = np.where(new, take(p[:m], width[:m]), k[:m])
                    p[:m] += np.where(new, width[:m], 0)
                    if (k[:m] == (1 << width[:m]) - 1).any():
                        raise ValueError("escaped residual partitions are not supported")
            live = i >= order[:m] if i < highest else slice(None)
            at, kk = p[:m][live], k[:m][live]
            stop = ones[before[at]].astype(np.int64)
            rest = stop + 1
            low = (words[rest >> 3] >> (32 - (rest & 7) - kk)) & ((1 << kk) - 1)
            codes[i, :m][live] = ((stop - at) << kk) | low
            p[:m][live] = rest + kk
        by_sample = (codes >> 1) ^ -(codes & 1)
        residual = by_sample.T.astype(np.int64)
        for o in np.unique(order):
            rows = np.flatnonzero((order == o) & ~general)
            if len(rows):
                r = residual[rows]
                # warm-up samples as leading differences, then one running sum per order
                lead = warm[rows, :o]
                for level in range(o):
                    r[:, level] = np.diff(lead, level, axis=1)[:, 0] if o > level else 0
                for level in range(o - 1, -1, -1):
                    r[:, level:] = np.cumsum(r[:, level:], axis=1)
                out[rice[rows]] = r
            rows = np.flatnonzero((order == o) & general)
            if len(rows):
                r = by_sample[:, rows].astype(np.int64)
                r[:o] = warm[rows, :o].T
                c, s = coefficients[rows, :o].T.copy(), shift[rows]
                for i in range(int(o), len(r)):
                    said = c[0] * r[i - 1]
                    for j in range(1, int(o)):
                        said += c[j] * r[i - 1 - j]
                    r[i] += said >> s
                out[rice[rows]] = r.T
    return out[valid].astype(np.int8)


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The bytes behind each stream; ValueError where a checksum, a length or the samples' MD5 does not hold."""
    known = [seek_table(s) for s in streams]
    starts, ends, counts, pieces, at = [], [], [], [], 0
    for s, (_, begin, points, _) in zip(streams, known, strict=True):
        first = points["byte"].astype(np.int64) + at
        starts.append(first)
        ends.append(np.append(first[1:], at + len(s) - begin))
        counts.append(points["n"].astype(np.int64))
        pieces.append(np.frombuffer(s, np.uint8)[begin:])
        at += len(s) - begin
    data, starts, ends, counts = map(np.concatenate, (pieces, starts, ends, counts))
    samples = []
    for a in range(0, len(starts), FRAMES):
        part = slice(a, a + FRAMES)
        low, high = starts[part][0], ends[part][-1]
        samples.append(decode_frames(data[low:high], starts[part] - low, ends[part] - low, counts[part]))
    flat = np.concatenate(samples)
    bounds = np.cumsum([0, *(k[0] for k in known)])
    if bounds[-1] != len(flat):
        raise ValueError("a stream's samples are not as many as it says")
    out = []
    for (_, _, _, md5), a, b in zip(known, bounds[:-1], bounds[1:], strict=True):
        if hashlib.md5(flat[a:b].tobytes()).digest() != md5:
            raise ValueError("a stream's samples do not match its MD5")
        out.append(flat[a:b].view(np.uint8) ^ 0x80)
    return out


def padded(flat: np.ndarray, offsets: np.ndarray, unit: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Rows with zero bytes appended up to a positive multiple of ``unit``."""
    sizes = np.diff(offsets)
    wanted = np.maximum(unit, -(-sizes // unit) * unit)
    new = np.concatenate(([0], np.cumsum(wanted)))
    out = np.zeros(new[-1], np.uint8)
    _scatter(out, new[:-1], flat, offsets[:-1], sizes)
    return out, new


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a FLAC stream.

    Null and empty texts: 64 zero bytes. Null doc_id and repeated rows are kept as they are; equal texts give equal
    streams. No rows in: no rows out. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encoded(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, flat, offsets in chunks(texts):
                media = encode(*padded(flat, offsets))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(encoded, f"doc_id {kind}, n_bytes long, media binary")


def blocks(streams: list[bytes]):
    """(stream, first sample, bytes) of every PCM block behind the streams, in order."""
    for i, x in enumerate(decode(streams)):
        for at in range(0, len(x), BLOCK):
            yield i, at, x[at : at + BLOCK]


def features(media: DataFrame) -> DataFrame:
    """The digests and signal features of the media's PCM blocks; nothing is taken from the text.

    n_blocks and last_offset: the blocks, and the first sample of the last one.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset"]

    def described(batches):
        for batch in batches:
            ids, sizes, streams = batch.column(0), batch.column(1), batch.column(2)
            for a, b, flat, offsets in chunks(streams):
                parts = [flat[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                rows = []
                for i, pcm in groupby(blocks(parts), itemgetter(0)):
                    digest, s = hashlib.sha256(), parts[i]
                    size = peak = energy = crossings = n = at = 0
                    tail, last = b"", None
                    for _, at, block in pcm:
                        digest.update(block)
                        tail = (tail + block[-PAD:].tobytes())[-PAD:]
                        v = block.astype(np.int32) - 128
                        low = v < 0
                        crossings += int(np.count_nonzero(low[1:] != low[:-1])) + (last is not None and bool(low[0]) != last)
                        size, n, last = size + len(block), n + 1, bool(low[-1])
                        peak, energy = max(peak, int(np.abs(v).max())), energy + int((v * v).sum())
                    rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), f"frames={n};peak={peak};energy={energy};crossings={crossings}", n, at))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), sizes.slice(a, b - a), *columns], names)

    return media.mapInArrow(described, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_offset long")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: one row per block, seekable by its first sample."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for a, _, flat, offsets in chunks(batch.column(2)):
                streams = [flat[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                for i, pcm in groupby(blocks(streams), itemgetter(0)):
                    _, at, data = zip(*pcm, strict=True)
                    ids = pa.repeat(batch.column(0)[a + i], len(at))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array([x.tobytes() for x in data], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(cut, f"doc_id {kind}, sample_offset long, pcm binary")


def op8_flac(spark, sf_dir: str) -> DataFrame:
    return features(to_media(table(spark, sf_dir, "documents")))
