"""Hashes of words for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = bytes(int(b in b" \t\n\v\f\r") for b in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 17  # bytes at a time, so that the arrays on the way stay in a core's cache
LONG = 64  # words beyond so many bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _piece(raw: bytes, cuts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; a word ends at each of `cuts` too."""
    raw = raw.translate(_LOWER)
    blank = np.frombuffer(raw.translate(_SPACE), dtype=np.bool_)
    n = len(raw)
    edge = np.empty(n + 1, dtype=np.bool_)
    edge[0], edge[n] = not blank[0], not blank[-1]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    cuts = cuts[~blank[cuts] & ~blank[cuts - 1]]
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    size = end - start
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + (size.astype(np.uint64) + np.uint64(seed)) * GOLDEN)
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        h[more] = mix(h[more] * GOLDEN + (eight[start[more] + k] & _MASK[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], seed=seed)
    return h, start


def _cut(view: memoryview, offsets: np.ndarray, lo: int) -> int:
    """Where the piece that begins at `lo` ends: between two texts, or behind white space in a text longer than a piece."""
    hi = lo + PIECE
    if hi >= offsets[-1]:
        return int(offsets[-1])
    k = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
    if k > lo:
        return k
    stop = int(offsets[np.searchsorted(offsets, lo, "right")])
    while hi < stop:
        gaps = np.flatnonzero(np.frombuffer(bytes(view[lo:hi]).translate(_SPACE), dtype=np.bool_))
        if len(gaps):
            return lo + int(gaps[-1]) + 1
        hi = lo + 2 * (hi - lo)
    return stop


def word_hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an Arrow array of texts, and the number of words of each.

    Words stand between ASCII white space; A-Z count as a-z; nulls have no words."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    lo, end = int(offsets[0]), int(offsets[-1])
    hashes, starts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    while lo < end:
        hi = _cut(view, offsets, lo)
        inner = np.unique(offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)])
        h, s = _piece(bytes(view[lo:hi]), inner - lo, seed)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))
