"""Word hashes of the texts of a record batch, for all words of many texts at once.

The hash of a word is a polynomial of its bytes: a difference of running sums,
moved to the same place by the inverse power, and mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from failtriage.llm.common import claim, mix

#: Bytes of text hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


@dataclass
class Words:
    """Words of texts ``first`` to ``first + len(counts) - 1`` of a batch, one after the other."""

    first: int
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        """Where the words of each text start."""
        return np.cumsum(self.counts) - self.counts

    @property
    def owner(self) -> np.ndarray:
        """The text of each word, from 0."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place in its text and how many words the text has from there on."""
        local = np.arange(len(self.hashes)) - np.repeat(self.starts, self.counts)
        return local, np.repeat(self.counts, self.counts) - local


def _hashed(data: np.ndarray, edges: np.ndarray, first: int, lower: bool) -> Words:
    inside = _IN_WORD[data]
    open_, close = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1]
    close[:-1] &= ~inside[1:]
    firsts = edges[:-1][edges[:-1] < len(data)]
    open_[firsts] = inside[firsts]
    lasts = edges[1:][edges[1:] > 0] - 1
    close[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
    values = (_LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= _power(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(first, np.diff(np.searchsorted(starts, edges)), mix(h))


def word_hashes(batch: pa.RecordBatch, name: str = "text", lower: bool = False) -> Iterator[Words]:
    """Words of a string column, some texts at a time; null texts have none. ``lower``: A to Z as a to z."""
    claim("wordhash", _powers.clear)
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        edges = offsets[at : end + 1] - offsets[at]
        yield _hashed(data[offsets[at] : offsets[end]], edges, at, lower)
        at = end
