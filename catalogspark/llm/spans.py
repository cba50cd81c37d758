"""Byte spans of words in Arrow text columns, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII capitals to small letters; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes that are gathered at a time.
BLOCK = 1 << 20


def word_spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> (starts, ends, first): the words of all values in order; those of value i
    are first[i] to first[i + 1]. `separators` says of each byte whether it
    parts words; no word reaches over the end of a value."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    edges = at[:-1][at[:-1] < at[1:]]  # first bytes of values that have any
    starts[edges] = inside[edges]
    if len(edges):
        ends[edges[1:] - 1] = inside[edges[1:] - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one behind the other, and the spans' places there;
    no more than about BLOCK places are spelled out at a time."""
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    low = 0
    while low < len(starts):
        base = int(at[low])
        high = max(low + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        stop = int(ends[high - 1])
        if high == low + 1:
            out[base:stop] = data[int(starts[low]) : int(starts[low]) + stop - base]
        else:
            out[base:stop] = data[np.arange(base, stop) + np.repeat(starts[low:high] - at[low:high], lengths[low:high])]
        low = high
    return out, at


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow column of UTF-8 text."""
    flat, at = gather(data, starts, ends - starts)
    places = np.append(at, len(flat)).astype(np.int64)
    wide = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(flat)))
    return wide.cast(pa.string()) if len(flat) < 1 << 31 else wide
