"""Word boundaries and word hashes of whole Arrow batches of text, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix, series

_BYTE = series(1, 256)
_PLACE = series(2, 64) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set bytes; no run goes on into the next row."""
    n = len(mask)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = mask[1:] & ~first[1:]
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends


def hashes(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, a function of its bytes alone."""
    global _PLACE
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_PLACE):
        _PLACE = series(2, 1 << longest.bit_length()) | np.uint64(1)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum()))
    place -= np.repeat(offsets, lengths)
    part = _PLACE.take(place)
    with np.errstate(over="ignore"):
        part *= _BYTE.take(data[mask])
        return mix(np.add.reduceat(part, offsets))
