"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.
All separators are ASCII, so UTF-8 bytes can be scanned without decoding. A word's hash is
the sum of random 64-bit numbers, one for each pair of a place and a byte (tabulation
hashing): two different words are equal with a chance of 2**-64, whatever their letters.
Words of more than ``PLACES`` bytes have the xxh3 of their bytes instead. Texts are handled
in slices of about ``SLICE_BYTES`` so that memory does not follow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
PLACES = 64

_rng = np.random.default_rng(20240607)
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_NUMBERS = _rng.integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**64, 16, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) of runs of rows; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1 + array.offset)[array.offset :]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the index of the first word of each document
    (with the total at the end)."""
    n = len(data)
    word = ~_SEP[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] = word[heads]
    inside = np.flatnonzero(word)
    starts = np.flatnonzero(begin)
    first = np.searchsorted(inside, starts)
    size = np.diff(np.append(first, len(inside)))
    place = inside - np.repeat(starts, size)
    np.minimum(place, PLACES - 1, out=place)
    place *= 256
    place += _FOLD[data[inside]]
    hashes = np.add.reduceat(_NUMBERS[place], first)
    for i in np.flatnonzero(size > PLACES):
        import xxhash

        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]].tobytes().lower())
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with repeats, and the first index of each document.
    A document of fewer words has its whole sequence as one shingle; without words, none."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    n_shingles = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(n_shingles, out=bounds[1:])
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _STEP[j]
    out = np.empty(bounds[-1], np.uint64)
    long = np.flatnonzero(counts >= k)
    if len(long):
        at = np.repeat(first[long] - bounds[long], n_shingles[long])
        where = np.repeat(bounds[long], n_shingles[long])
        inside = np.arange(len(where)) - np.repeat(np.cumsum(n_shingles[long]) - n_shingles[long], n_shingles[long])
        out[where + inside] = rolled[where + inside + at]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[first[d] : first[d + 1]]
        step = np.array([*_STEP[: len(own)], _STEP[14]], np.uint64)
        out[bounds[d]] = np.sum(np.append(own, np.uint64(len(own))) * step)
    return mix(out), bounds
