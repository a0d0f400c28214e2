"""Words of whole Arrow columns as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All functions
work on the bytes of many texts at once; a text is never cut.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLANKS = [0x20, *range(0x09, 0x0E)]
_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def _table(*groups) -> np.ndarray:
    table = np.ones(256, bool)
    for group in groups:
        table[group] = False
    return table


IN_WORD = _table(_BLANKS)
IN_TERM = _table(_BLANKS, _PUNCTUATION)  # ASCII punctuation separates as well
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BYTE = np.random.default_rng(20240131).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)


def u64(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """Powers 0 to n of the base; kept, as every block needs them."""
    global _powers
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, u64(_BASE))
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def _inverse(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) <= n:
        steps = np.full(max(n + 1, 1 << 16), u64(pow(_BASE, -1, 1 << 64)))
        steps[0] = 1
        _inverses = np.multiply.accumulate(steps)
    return _inverses


_inverses = np.ones(1, np.uint64)


@dataclass
class Words:
    """``data[start[i]:end[i]]`` is word i; text t has the words ``first[t]:first[t + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 17
        for a in range(0, len(out), step):
            s, e = self.start[a:a + step], self.end[a:a + step]
            low, high = int(s[0]), int(e[-1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * _power(high - low)[:high - low], out=sums[1:])
            out[a:a + step] = mix((sums[e - low] - sums[s - low]) * _inverse(high - low)[s - low]
                                  + (e - s).astype(np.uint64))
        return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                                  else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
                inside: np.ndarray = IN_WORD) -> Words:
    if lower:
        data = LOWER[data]
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = inside[data]
    starts, ends = flags[1:-1] & ~flags[:-2], flags[1:-1] & ~flags[2:]
    # the edge between two texts always separates
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = flags[edges + 1]
    ends[edges - 1] = flags[edges]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(words: Words, n: int) -> np.ndarray:
    """True for each word at which ``n`` words of one text start."""
    out = np.zeros(len(words.start), bool)
    if len(out) >= n:
        texts = words.text_of()
        out[:len(out) - n + 1] = texts[:len(out) - n + 1] == texts[n - 1:]
    return out


def join_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``n`` words from each word on; the last ``n - 1`` entries mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    m = len(hashes) - n + 1
    if m > 0:
        for i in range(n):
            out[:m] = out[:m] * u64(_MULTIPLIER) + hashes[i:i + m]
        out[:m] = mix(out[:m])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that memory stays bounded."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        _, offsets = bytes_of(values)
        a = 0
        while a < len(values):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def packed(data: np.ndarray, offsets: np.ndarray, kind=pa.binary()) -> pa.Array:
    """A binary or string column from bytes and offsets."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for all i, in one array."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)
