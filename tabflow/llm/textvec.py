"""Vectorised text handling for Arrow batches inside tasks: UTF-8 bytes of a whole batch as one numpy array.

Nothing here works row by row: words, hashes and shingles of a slice of documents come from a few passes over its
bytes. Slices hold about ``SLICE_BYTES`` of text (one longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 1 << 19
#: Odd base of the rolling hash and the finaliser constants of the 64-bit mix (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
_POW: dict = {}


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null counts as the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], wide)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the next call."""
    have = _POW.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        out = []
        for base in (BASE, inv):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POW["p"] = have = tuple(out)
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of (code + 1) * BASE**i: differences, shifted by BASE**-start, are hashes of any span."""
    p, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[:len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the text behind ``prefix``."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * MIX1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return np.where(up, data + 32, data).astype(np.uint8)


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask`` that stay inside one row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:n]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    return spans(~((data == 32) | ((data >= 9) & (data <= 13))), offs)


def row_bounds(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For spans in row order: index of each row's first span (and the number of spans at the end)."""
    return np.searchsorted(starts, offs, "left")


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles (fewer words: the whole sequence is one)."""
    low = lower_ascii(data)
    s, e = words(low, offs)
    first = row_bounds(s, offs)
    if len(s) == 0:
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    h = span_hash(rolling(low), s, e)
    p, _ = powers(k + 2)
    full = max(len(h) - k + 1, 0)
    acc = np.zeros(full, np.uint64)
    for j in range(k):
        acc += h[j:j + full] * p[j + 1]
    acc = mix(acc)
    out = []
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(acc[a:b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * p[1:b - a + 1]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
