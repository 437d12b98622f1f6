"""Words and word windows of a whole Arrow column as numpy arrays, straight from its UTF-8 buffer.

A word's 64-bit hash puts each of its eight-byte blocks, with the block's place, through an avalanche mixer and sums them:
no step is linear in the text, so no two words meet by their structure. Windows are hashed by doubling: two runs of 1, 2,
4, ... words are mixed into one. Equal words have equal hashes on every executor: all constants are fixed. Where words
must be equal for certain, `equal_runs` compares their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_PAIR = U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The avalanche step of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _blocks(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The eight-byte blocks of byte runs (zeros after a run's end), each block's number in its run, and where runs begin."""
    count = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(count) - count
    k = np.arange(int(count.sum())) - np.repeat(first, count)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    left = np.minimum(np.maximum(np.repeat(length, count) - 8 * k, 0), 8)
    return every[np.minimum(np.repeat(at, count) + 8 * k, len(data))] & _MASK[left], k, first


def equal_runs(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which byte runs a to a_end hold the same bytes as b to b_end."""
    same = (a_end - a) == (b_end - b)
    at = np.flatnonzero(same)
    if len(at):
        length = a_end[at] - a[at]
        (x, _, first), (y, _, _) = _blocks(data, a[at], length), _blocks(data, b[at], length)
        same[at] = np.logical_and.reduceat(x == y, first)
    return same


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (nulls: no bytes)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, one row at least; nothing is copied."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    offs = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """All words of a column: start, end (bytes), row, hash, and first (where each row's words begin, one more at the end)."""

    def __init__(self, column: pa.Array | None = None, lower: bool = False, raw: tuple[np.ndarray, np.ndarray] | None = None):
        """Of a column, or of raw bytes and where each row starts."""
        data, offs = buffers(column) if raw is None else raw
        n, rows = len(data), len(offs) - 1
        self.data, self.offsets = data, offs
        if n == 0:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            self.first = np.zeros(rows + 1, np.int64)
            return
        inside = ~_SEP[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = offs[(offs > 0) & (offs < n)]
        before[cut], after[cut - 1] = False, False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offs, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offs)
        if not len(self.start):
            self.hash = np.zeros(0, U)
            return
        if lower:
            self.data = data = _LOWER[data]
        block, k, first = _blocks(data, self.start, self.end - self.start)
        self.hash = mix(np.add.reduceat(mix(block ^ (k.astype(U) + U(1)) * _GOLD), first) + (self.end - self.start).astype(U))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words (by their first word's index), and which of them lie in one row."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        out, have = self.hash, 1
        while have < size:
            step = min(have, size - have)
            out = mix(out[: len(out) - step] * _PAIR + out[step:])
            have += step
        return out, self.row[:n] == self.row[size - 1 :]
