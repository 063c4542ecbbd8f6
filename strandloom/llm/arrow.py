"""NumPy views of Arrow columns, shared by the Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (nulls as empty) and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    d = np.frombuffer(data, np.uint8, int(o[-1])) if data is not None and o[-1] else np.empty(0, np.uint8)
    return d[int(o[0]):], o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads uint64 values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, … of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
