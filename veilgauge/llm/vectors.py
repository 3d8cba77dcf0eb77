"""Vectors of whole numbers as bytes: floor(256 * c) of every entry c, packed by row and by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256
_LONG = 2.0**63


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, lengths, values) of a list array: floor(256 * c) as 64-bit integers, the usable rows' one after the other.

    A null list, or one that holds a null or an entry that is not finite, is not
    usable. Entries beyond the 64-bit range stand at its ends.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lists = vectors.cast(pa.large_list(pa.float64()))
    present = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(present, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    entries = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes a NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    usable = present & (np.bincount(owner, ~np.isfinite(entries), len(lengths)) == 0)
    scaled = np.floor(SCALE * entries[usable[owner]])
    top = scaled >= _LONG
    return usable, lengths[usable], np.where(top, np.iinfo(np.int64).max, np.where(top, 0, np.maximum(scaled, -_LONG)).astype(np.int64))


def padded(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of one length: shorter vectors are filled up with zeros."""
    if len(lengths) and (lengths == lengths[0]).all():
        return values.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = values
    return out


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, equal for equal rows whatever zeros they end in: 16-bit numbers where all fit, else 64-bit."""
    n, d = x.shape
    ends = d - np.argmax((x != 0)[:, ::-1], axis=1) if d else np.zeros(n, np.int64)
    ends = np.where((x != 0).any(axis=1), ends, 0)
    small = ((x >= -(1 << 15)) & (x < 1 << 15)).all(axis=1)
    narrow, wide = x.astype("<i2"), x.astype("<i8")
    return [b"\2" + narrow[i, :e].tobytes() if s else b"\10" + wide[i, :e].tobytes() for i, (e, s) in enumerate(zip(ends.tolist(), small.tolist()))]


def unpack_rows(rows: list[bytes], dims: int = 0) -> np.ndarray:
    """The inverse of pack_rows, as one matrix of at least `dims` columns."""
    parts = [np.frombuffer(r, "<i2" if r[0] == 2 else "<i8", offset=1) for r in rows]
    out = np.zeros((len(rows), max([dims, *map(len, parts)])), np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))
