"""Vectorised text kernels on Arrow batches: bytes, words and shingle hashes without per-word Python.

All kernels work on one chunk of rows at a time; a chunk holds at most CHUNK_BYTES of text, or one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of ASCII letters, digits and everything outside ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes of a class; a run ends with its row."""
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    w = inside[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are disjoint and in order. Worked off in stretches of CHUNK_BYTES, whatever
    the length of the text or of one span."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(CHUNK_BYTES + 1)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        if ends[a] - base > CHUNK_BYTES:
            total = 0
            for at in range(base, int(ends[a]), CHUNK_BYTES):
                part = flat[at : min(at + CHUNK_BYTES, int(ends[a]))].astype(np.uint64) + np.uint64(1)
                total += int((part * up[: len(part)]).sum()) * pow(_P, at - base, 1 << 64)
            out[a] = total & _MASK
        else:
            part = flat[base : ends[b - 1]]
            weighted = (part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]
            # a sum over start..end, the separators after it not counted
            bounds = np.empty(2 * (b - a), np.int64)
            bounds[0::2], bounds[1::2] = starts[a:b] - base, ends[a:b] - base
            out[a:b] = np.add.reduceat(weighted, bounds[:-1])[0::2] * down[bounds[0::2]]
        a = b
    return mixed(out)


def spaced_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the lower-cased words between ASCII white space."""
    low = LOWER[flat]
    starts, ends, rows = spans(low, offsets, SPACED)
    return span_hashes(low, starts, ends), rows


_SHIFTS = [mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(16)]


def combined(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive word hashes, whatever rows they lie in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _SHIFTS[j]
    return mixed(out)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a shorter row is one shingle, an empty one has none."""
    hashes, rows = spaced_words(flat, offsets)
    whole = combined(hashes, k)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            part = np.sort(whole[a : b - k + 1])
            out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part)
        else:
            out.append(combined(hashes[a:b], b - a) if b > a else hashes[:0])
    return out
