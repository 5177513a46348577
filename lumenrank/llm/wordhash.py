"""Word boundaries and 64-bit word hashes of a whole Arrow batch of texts, vectorised over words.

A word is read in lanes of eight bytes. Its hash starts from its length and takes a lane at a time,
with a full 64-bit mixer after each, so two words of one length up to eight bytes never share a hash,
and longer ones do so only by chance: no structure of the bytes cancels out, as it does in a
polynomial modulo 2**64. Spans beyond ``LONG`` bytes are hashed one by one with XXH3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
LONG = 128  # bytes of a span from which a call for each costs less than its lanes
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)  # masks of the first k bytes of a lane


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z as a-z
SPACE_NEWLINE = np.zeros(256, bool)
SPACE_NEWLINE[[0x20, 0x0A]] = True
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and per text the index of its first word (n+1 values)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, fold: bool = False) -> np.ndarray:
    """One hash per span of bytes; ``fold`` lower-cases A-Z."""
    if fold:
        data = _LOWER[data]
    eight, n = lanes(data), ends - starts
    out = mix((mix(n.astype(_U) * _ODD) ^ (eight[starts] & FIRST[np.minimum(n, 8)])) * _ODD)
    rest, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(rest):
        left = n[rest] - at
        lane = eight[starts[rest] + at] & FIRST[np.minimum(left, 8)]
        out[rest] = mix(out[rest] * _ODD + lane)
        at += 8
        rest = rest[left > 8]
    long = np.flatnonzero(n > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxh3_64_intdigest(raw[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` hashes, from runs of 1, 2, 4, ... of them, each half mixed in its place."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, at, size = None, 0, 1
    while True:
        if width & size:
            part = h[at : at + n]
            out = part if out is None else mix(out * _ODD + part)
            at += size
        if 2 * size > width:
            return out
        h = mix(h[:-size] * _ODD + h[size:])
        size *= 2


def blocks(texts: pa.Array, max_bytes: int = 1 << 20):
    """Runs of whole texts of about ``max_bytes``: (first row, bytes, offsets). One long text is one run."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
