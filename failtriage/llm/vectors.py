"""Vectors of a table as integer matrices in numpy batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scaled components must stay below this, so that they are exact as 64-bit floats as well.
LARGEST = 1 << 52


def rows_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and values of the vectors of a list column, by length.

    Null vectors, empty ones, and those with a null, infinite or NaN entry have no place in the result.
    """
    lists = column.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values
    bad = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(flat))])
    start, end = offsets[:-1], offsets[1:]
    length = np.where(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[start]), end - start, 0)
    out = {}
    for size in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == size)
        out[size] = at, flat[start[at][:, None] + np.arange(size)]
    return out


def scaled(values: np.ndarray, factor: float) -> np.ndarray:
    """The integers ``floor(factor * value)``."""
    x = np.floor(factor * values)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError("a component is too large for exact integers")
    return x.astype(np.int64)


def commonest(counts: dict[int, int]) -> int | None:
    """The length that most vectors have; of equally common ones the greatest."""
    return max(counts, key=lambda size: (counts[size], size), default=None)
