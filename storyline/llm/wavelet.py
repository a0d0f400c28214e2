"""A wavelet matrix: a sequence of token ids as bit-planes with rank and select.

The planes go from the highest bit down; below each, the sequence is split into
the ids with a 0 and those with a 1, order kept.  A file holds one shard: the
documents in it, and per plane blocks of 2**16 bits, compressed one by one, with
the ones before each block.  So a token, a count or an occurrence is found from
the compressed file by opening the blocks on its way only.
"""
from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WVM2"
_BLOCK = 1 << 16
_KEPT = 64  # opened blocks that are kept


def encode(ids: np.ndarray, keys: list[int | None], counts: np.ndarray, bits: int = 16) -> bytes:
    """The file of one shard: ids of the documents ``keys``, ``counts`` ids each."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"the id {int(ids.max())} does not fit into {bits} bits")
    squeeze = zstandard.ZstdCompressor(level=1)
    planes, zeros = [], []
    rest = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = (rest >> level & 1).astype(bool)
        zeros.append(len(bit) - int(np.count_nonzero(bit)))
        planes.append(bit)
        rest = np.concatenate([rest[~bit], rest[bit]])
    known = np.array([k is not None for k in keys], np.uint8)
    head = [_MAGIC, struct.pack("<QQI", len(ids), len(keys), bits),
            np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes(), counts.astype("<u8").tobytes(),
            np.array(zeros, "<u8").tobytes()]
    body, directory, at = [], [], 0
    for bit in planes:
        ones = 0
        for a in range(0, len(bit), _BLOCK):
            part = bit[a:a + _BLOCK]
            raw = np.packbits(part, bitorder="little").tobytes()
            small = squeeze.compress(raw)
            plain = len(small) >= len(raw)
            body.append(raw if plain else small)
            directory.append((at, ones, plain))
            at += len(body[-1])
            ones += int(np.count_nonzero(part))
    table = np.array(directory, np.int64).reshape(-1, 3)
    return b"".join([*head, struct.pack("<QQ", len(table), at), table.astype("<i8").tobytes(), *body])


class WaveletMatrix:
    """Reads a shard's file."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, documents, self.bits = struct.unpack_from("<QQI", data, 4)
        at = 4 + 20

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        keys, known = take("<i8", documents), take("u1", documents)
        self.keys = [int(k) if has else None for k, has in zip(keys, known)]
        self.counts = take("<u8", documents).astype(np.int64)
        self.zeros = take("<u8", self.bits).astype(np.int64)
        blocks, size = struct.unpack_from("<QQ", data, at)
        at += 16
        self.table = take("<i8", blocks * 3).reshape(-1, 3)
        self.body = memoryview(data)[at:at + size]
        self.per_plane = -(-self.n // _BLOCK)
        self.opened: dict[int, np.ndarray] = {}

    def _block(self, level: int, block: int) -> np.ndarray:
        number = level * self.per_plane + block
        if number not in self.opened:
            if len(self.opened) >= _KEPT:
                self.opened.pop(next(iter(self.opened)))
            start, _, plain = self.table[number]
            end = self.table[number + 1][0] if number + 1 < len(self.table) else len(self.body)
            raw = self.body[start:end]
            raw = raw if plain else zstandard.ZstdDecompressor().decompress(raw)
            size = min(_BLOCK, self.n - block * _BLOCK)
            self.opened[number] = np.unpackbits(np.frombuffer(raw, np.uint8), count=size, bitorder="little")
        return self.opened[number]

    def _ones(self, level: int, end: int) -> int:
        """How many ones plane ``level`` has before place ``end``."""
        block, inside = divmod(end, _BLOCK)
        if block == self.per_plane:
            return self.n - int(self.zeros[level])
        before = int(self.table[level * self.per_plane + block][1])
        return before + (int(np.count_nonzero(self._block(level, block)[:inside])) if inside else 0)

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            block, inside = divmod(i, _BLOCK)
            bit = int(self._block(level, block)[inside])
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _interval(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs between two places."""
        a, b = self._interval(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) such bit of a plane."""
        rows = self.table[level * self.per_plane:(level + 1) * self.per_plane, 1]
        before = rows if bit else np.arange(self.per_plane) * _BLOCK - rows
        block = int(np.searchsorted(before, nth, "right")) - 1
        return block * _BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[nth - int(before[block])])

    def find(self, token: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) occurrence of the id."""
        start, end = self._interval(token, 0, self.n)
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        at = start + nth
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                at = self._select(level, 1, at - int(self.zeros[level]))
            else:
                at = self._select(level, 0, at)
        return at

    def decode(self) -> np.ndarray:
        """All ids.  From the lowest plane up, the two halves are put back in order."""
        planes = []
        for level in range(self.bits):
            parts = [self._block(level, b) for b in range(self.per_plane)]
            planes.append(np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool))
        rest = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit, zero = planes[level], int(self.zeros[level])
            out = np.empty_like(rest)
            out[~bit] = rest[:zero]
            out[bit] = rest[zero:] | rest.dtype.type(1 << (self.bits - 1 - level))
            rest = out
        return rest
