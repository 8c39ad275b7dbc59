"""Vectorised helpers shared by the Arrow operators of this package.

Texts arrive as Arrow string columns; the helpers work on their byte buffers,
a bounded slice of documents at a time, so that temporary arrays stay small
whatever the lengths of the texts.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

U64 = np.uint64
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15          # odd and 5 mod 8: a generator of long period modulo 2**64
_K1, _K2, _K3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * _K1
    x = (x ^ (x >> U64(27))) * _K2
    return x ^ (x >> U64(31))


_BYTE = mix64((np.arange(1, 257, dtype=np.uint64) * U64(_BASE)))
_powers = {"n": 0, "up": None, "down": None}


def _power_tables(n: int):
    if _powers["n"] < n:
        n = max(n, SLICE_BYTES + 1)
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(n, U64(b), dtype=np.uint64)
            t[0] = 1
            _powers[key] = np.cumprod(t, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document bounds) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(column, limit: int = SLICE_BYTES):
    """Consecutive documents of about ``limit`` bytes: (first, last, bytes, bounds)."""
    data, bounds = text_buffer(column)
    i, n = 0, bounds.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, j, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: (64-bit hashes, first word of each
    document and the end, byte starts, byte ends). ``lower`` folds A-Z first."""
    n = data.size
    if n == 0:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(bounds.size, np.int64), e, e
    solid = ~_SPACE[data]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    filled = bounds[1:] > bounds[:-1]
    b, z = bounds[:-1][filled], bounds[1:][filled] - 1
    head[b], tail[z] = solid[b], solid[z]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64) * _K3), np.searchsorted(start, bounds), start, end


def chain(*parts) -> np.ndarray:
    """Hash of equally long hash arrays taken as a sequence."""
    out = np.full_like(parts[0], U64(len(parts)))
    for p in parts:
        out = mix64(out * U64(_BASE) + p)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    v = np.sort(values)
    if v.size < 2:
        return v
    keep = np.empty(v.size, bool)
    keep[0] = True
    np.not_equal(v[1:], v[:-1], out=keep[1:])
    return v[keep]


def distinct_counts(values: np.ndarray):
    """Sorted distinct values and how often each occurs."""
    v = np.sort(values)
    if v.size == 0:
        return v, np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[at], np.diff(np.append(at, v.size))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int):
    """Sorted distinct hashes of the ``width``-word shingles of each document of a slice
    (words lower-cased); a document of fewer words has its whole sequence as the only one."""
    h, first, _, _ = words(data, bounds)
    runs = chain(*[h[i:h.size - width + 1 + i] for i in range(width)]) if h.size >= width else None
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield distinct(runs[a:b - width + 1])
        elif b > a:
            yield chain(*[h[i:i + 1] for i in range(a, b)])
        else:
            yield h[:0]


# ---- Golomb-Rice coded sorted hashes -------------------------------------------------

_HEAD = struct.Struct("<IBQ")


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb codes (divisor 2**k) of their gaps:
    a header, the quotients in unary, the remainders in k bits."""
    n = values.size
    if n == 0:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / n
    k = max(0, min(63, int(np.floor(np.log2(mean * np.log(2)))))) if mean > 2 else 0
    q = (gaps >> U64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + q.size, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    head = _HEAD.pack(n, k, int(values[0])) + struct.pack("<I", (unary.size + 7) // 8)
    if not k:
        return head + np.packbits(unary).tobytes()
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k:]
    return head + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def golomb_decode(coded: bytes) -> np.ndarray:
    n, k, first = _HEAD.unpack_from(coded)
    if n == 0:
        return np.empty(0, np.uint64)
    at = _HEAD.size
    (nu,) = struct.unpack_from("<I", coded, at)
    at += 4
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(coded, np.uint8, nu, at)))[:n - 1]
    q = np.diff(ends, prepend=-1) - 1
    gaps = q.astype(np.uint64) << U64(k)
    if k and n > 1:
        bits = np.unpackbits(np.frombuffer(coded, np.uint8, offset=at + nu), count=(n - 1) * k).reshape(-1, k)
        wide = np.zeros((n - 1, 64), np.uint8)
        wide[:, 64 - k:] = bits
        gaps |= np.packbits(wide, axis=1).reshape(-1, 8).copy().view(">u8").ravel().astype(np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = gaps
    return np.cumsum(out, dtype=np.uint64)


def counts_encode(counts: np.ndarray) -> bytes:
    """Counts as bytes, the few of 255 and more spelled out behind them."""
    big = counts[counts >= 255].astype("<u8")
    return struct.pack("<II", counts.size, big.size) + np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes()


def counts_decode(coded: bytes) -> np.ndarray:
    n, m = struct.unpack_from("<II", coded)
    out = np.frombuffer(coded, np.uint8, n, 8).astype(np.int64)
    if m:
        out[out == 255] = np.frombuffer(coded, "<u8", m, 8 + n).astype(np.int64)
    return out


# ---- bounded counting sketches -------------------------------------------------------

SEGMENTS = 64


class Sketch:
    """``2**bits`` counters of hashes, filled in a task and emitted in segments."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.counts, (hashes >> U64(64 - self.bits)).astype(np.int64), np.uint32(1))

    def parts(self):
        """(segment, bytes) of the segments that hold anything; a task's counter stops at 255."""
        for i, part in enumerate(self.counts.reshape(SEGMENTS, -1)):
            if part.any():
                yield i, np.minimum(part, 255).astype(np.uint8).tobytes()


def sketch_levels(parts, bits: int) -> np.ndarray:
    """Sum of the emitted segments (columns ``seg`` and ``counts``) as 2**bits levels from 0 to 255:
    twelve for a doubling of the count, 0 only for none. The size does not depend on the data."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, total = None, np.zeros((1 << bits) // SEGMENTS, np.int64)
        for b in batches:
            seg = b.column("seg")[:1]
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint8)
        level = np.minimum(255, np.floor(12 * np.log2(1.0 + total))).astype(np.uint8)
        yield pa.record_batch({"seg": seg, "levels": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((SEGMENTS, (1 << bits) // SEGMENTS), np.uint8)
    for r in parts.groupBy("seg").applyInArrow(add, "seg int, levels binary").collect():
        out[r["seg"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out.ravel()


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return values.view(np.int64)


def binaries(rows) -> pa.Array:
    return pa.array(list(rows), pa.binary())


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):          # another C library: it has no such call
    _trim = None


def give_back() -> None:
    """Return memory that Arrow and the C library hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(fn):
    """``fn`` (batches -> batches), giving unused memory back to the system after every batch,
    so that a worker between two tasks holds none of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in fn(batches):
            yield b
            del b
            give_back()
        give_back()
    return run


def tidy_group(fn):
    """The same for ``fn`` (table -> table)."""
    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        del table
        give_back()
        return out
    return run
