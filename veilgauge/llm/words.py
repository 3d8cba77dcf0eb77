"""Words of Arrow string arrays as NumPy arrays: one pass over the bytes, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that are expanded to arrays at once inside a task; a longer text is taken alone.
SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SHINGLE = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+ : everything but the space and the five control blanks
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False
#: runs of ASCII letters and digits and of all non-ASCII characters
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of n texts: word i spans bytes start[i]:end[i] of data; text t holds words split[t]:split[t+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    split: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.split)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.split) - 1), self.counts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets into them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, or of one longer row."""
    _, offsets = bytes_of(texts)
    low, n = 0, len(texts)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def words(texts: pa.Array, kind: np.ndarray = BLANK_SEPARATED, lower: bool = True, hashed: bool = True) -> Words:
    """Split texts into maximal runs of bytes of `kind`; equal words (ASCII case folded if lower) get equal hashes."""
    data, offsets = bytes_of(texts)
    n = len(data)
    inside = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    split = np.searchsorted(start, offsets)
    values = np.zeros(0, np.uint64)
    if hashed and len(start):
        index = np.int32 if n < 1 << 31 else np.int64  # half the memory for all but huge texts
        place = np.arange(start[0], n, dtype=index) - np.repeat(start.astype(index), np.diff(np.append(start, n)))
        live = inside[start[0]:]
        place[~live] = 0
        power = np.cumprod(np.full(int((end - start).max()), _BASE, np.uint64))
        value = (LOWER[data[start[0]:]] if lower else data[start[0]:]).astype(np.uint64) + np.uint64(1)
        value *= power[place]
        value[~live] = 0
        values = mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64) * SHINGLE)
    return Words(data, offsets, start, end, split, values)


def windows(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within a text; short: a text of fewer words is one window."""
    count = w.counts
    total = len(w.start)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(total, np.uint64)
    for j in range(min(k, total)):
        value[:total - j] = value[:total - j] * SHINGLE + w.hash[j:]
    first = np.arange(total)
    fits = first + k <= np.repeat(w.split[1:], count)
    first, value = first[fits], mix(value[fits])
    if short:
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                extra[has] = extra[has] * SHINGLE + w.hash[w.split[few[has]] + j]
            first = np.concatenate([first, w.split[few]])
            value = np.concatenate([value, mix(extra + count[few].astype(np.uint64))])
            order = np.argsort(first, kind="stable")
            first, value = first[order], value[order]
    return first, value
