"""Words of whole Arrow batches hashed at once with numpy; used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each starts and the last ends); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words start and the last end).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. They are
    hashed in blocks of about a megabyte, so memory beyond the texts is bounded.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begin)
    del begin, first
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        low, high = starts[at], starts[to] if to < len(starts) else len(data)
        own = starts[at:to] - low
        sizes = np.diff(np.append(own, high - low))
        place = np.arange(high - low) - np.repeat(own, sizes)
        used = inside[low:high]
        values = _LOWER[data[low:high]] * _power_table(int(place.max()) + 1)[place]
        values[~used] = 0
        out[at:to] = mix(np.add.reduceat(values, own))
        at = to
    return out, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int):
    """For each text the sorted distinct hashes of its runs of `width` words.

    A text of fewer words has its whole sequence as the only run; without words, none.
    """
    n = len(words)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for i in range(width):
        rolled += words[i : n - width + 1 + i] * mix(np.full(1, i + 1, np.uint64))[0] if len(rolled) else rolled
    rolled = mix(rolled)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            yield np.unique(rolled[low : high - width + 1])
        elif high > low:
            short = np.full(1, high - low, np.uint64)
            for i in range(low, high):
                short = mix(short * _BASE + words[i : i + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)
