"""Texts as token ids in wavelet-matrix files, in the order of their keys.

The texts are dealt by key ranges and sorted.  A task encodes its texts and writes
one file for about ``SHARD_TOKENS`` ids; a text is never divided.  What a task
returns names its files, so files of a lost attempt are never read.

The tokenizer splits a text before most blanks and punctuation, and what stands
between two such places always gets the same ids.  So each different piece is
encoded once and its ids are copied; a bounded number of pieces is remembered
from one batch to the next.  A string that is an added token of the tokenizer is a
piece of its own, and the text on both sides of it is split as if it ended there.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, scratch_path
from . import store
from .rows import shuffle_width
from .wavelet import WaveletMatrix, encode
from .words import Words, bytes_of, ranges, slices

SHARD_TOKENS = 1 << 21
END = 0
_REMEMBERED = 1 << 20  # pieces

_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PRINTED & ~_LETTER
_MARK[[*range(0x30, 0x3A), 0x27]] = False  # digits and the apostrophe are left to the tokenizer


def added_places(raw: bytes, offsets: np.ndarray, added: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Where added tokens start and end; none reaches from one text into the next."""
    start, end, at = [], [], 0
    while found := added.search(raw, at):
        a, b = found.span()
        text_end = int(offsets[np.searchsorted(offsets, a, "right")])
        at = b
        if b > text_end:
            at = a + 1
        else:
            start.append(a)
            end.append(b)
    return np.array(start, np.int64), np.array(end, np.int64)


def piece_starts(data: np.ndarray, offsets: np.ndarray, added: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Places at which byte-level BPE with the usual word pattern always starts a new word.

    Before a space that leads a printed character, around a single line end
    between printed characters, and between a letter and a mark.  ``added`` tokens
    (starts, ends) are pieces.
    """
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    edges = offsets[1:-1]
    if added is not None:
        edges = np.concatenate([edges, *added])
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges], after[edges - 1] = 0, 0
    blank = np.isin(after, [0, *range(0x09, 0x0E), 0x20])
    start = (data == 0x20) & (_PRINTED[after] | (_PRINTED[before] & ~blank))
    line = (data == 0x0A) & _PRINTED[before] & _PRINTED[after]
    start |= line | (_MARK[data] & _LETTER[before])
    start[1:] |= line[:-1]
    if added is not None:
        start[ranges(added[0], added[1] - added[0])] = False
    start[edges] = True
    if len(data):
        start[0] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of pieces, remembered by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self._forget()

    def _forget(self) -> None:
        """``pool[begin[i]:begin[i] + size[i]]`` are the ids of the piece with the hash ``hashes[i]``."""
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        raw = data.tobytes()
        start = piece_starts(data, offsets, added_places(raw, offsets, self.added) if self.added else None)
        end = np.concatenate([start[1:], [len(data)]]).astype(np.int64)
        pieces = Words(data, offsets, start, end, np.searchsorted(start, offsets))
        hashes = pieces.hashes()
        unique, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > _REMEMBERED:
            self._forget()
        known = np.searchsorted(self.hashes, unique)
        hit = np.zeros(len(unique), bool)
        if len(self.hashes):
            hit = self.hashes[np.minimum(known, len(self.hashes) - 1)] == unique
        fresh = np.flatnonzero(~hit)
        texts = [raw[start[e]:end[e]].decode() for e in example[fresh]]
        new = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self._remember(unique[fresh], known[fresh], np.fromiter(map(len, new), np.int64, len(new)), chain.from_iterable(new))
        place = np.searchsorted(self.hashes, unique) if len(fresh) else known
        begin, count = self.begin[place], self.size[place]
        per_piece = count[which]
        out = self.pool[ranges(begin[which], per_piece)]
        total = np.concatenate([[0], np.cumsum(per_piece)])
        return out, np.diff(total[pieces.first])

    def _remember(self, hashes: np.ndarray, place: np.ndarray, size: np.ndarray, ids: Iterator[int]) -> None:
        """Put sorted new hashes in their places; ids stay where they were appended."""
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(total, self.used), np.uint32)])
        self.pool[self.used:self.used + total] = np.fromiter(ids, np.uint32, total)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.begin = np.insert(self.begin, place, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.used += total


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _written(folder: str, tokenizer: str, shard_tokens: int):
    names = ["part", "seq", "file", "n_tokens"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer), TaskContext.get()
        part, seq = task.partitionId(), 0
        ids, keys, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{task.taskAttemptId()}-{seq:06d}.wvm"
            every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            store.put(path, encode(every, keys, np.concatenate(counts), encoder.bits))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                                               pa.array([path]), pa.array([len(every)], pa.int64())], names=names)

        for batch in slices(batches, "__text", 2 << 20):
            own, size = encoder.encode(*bytes_of(batch.column("__text")))
            # the end mark after each text
            place = np.cumsum(size + 1) - 1
            full = np.full(len(own) + len(size), END, np.uint32)
            inner = np.ones(len(full), bool)
            inner[place] = False
            full[inner] = own
            ids.append(full)
            keys.extend(batch.column("__key").to_pylist())
            counts.append(size + 1)
            held += len(full)
            if held >= shard_tokens:
                yield flush()
                seq += 1
                ids, keys, counts, held = [], [], [], 0
        if keys:
            yield flush()
    return write


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text",
                      shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files and return ``(part, seq, file, n_tokens, start)``, one row per file.

    ``start`` is the number of ids in all files before.  Keys ascend (null first)
    within and across files, equal keys by text; null texts are empty and have
    their end mark only.
    """
    work = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    files = cut_lineage(
        work.repartitionByRange(shuffle_width(docs.sparkSession), F.col("__key").asc_nulls_first())
        .sortWithinPartitions(F.col("__key").asc_nulls_first(), "__text")
        .mapInArrow(_written(folder, tokenizer, shard_tokens), "part int, seq int, file string, n_tokens long"))
    # one row per task reaches the driver
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if not base:
        return files.withColumn("start", F.lit(0).cast("long"))
    bases = docs.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    return files.join(F.broadcast(bases), "part").select(
        "part", "seq", "file", "n_tokens",
        (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start"))


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids)`` of every text, from the files alone; ids as little-endian bytes."""
    return _read(files, key, lambda ids: pa.array(ids, pa.binary()), "binary", "ids")


def check_sums(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every text, from the files alone."""
    return _read(files, key, lambda ids: pa.array([zlib.crc32(i) for i in ids], pa.int64()), "long", "ids_crc32")


def _read(files: DataFrame, key: str, column, kind: str, name: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                matrix = WaveletMatrix(store.get(path))
                ids = matrix.decode().astype("<u4")
                edge = np.concatenate([[0], np.cumsum(matrix.counts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.keys, pa.int64()), pa.array(start + edge[:-1]), pa.array(matrix.counts),
                     column([ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])])],
                    names=[key, "start", "n_tokens", name])

    width = max(1, shuffle_width(files.sparkSession))
    return files.select("file", "start").repartition(2 * width, "file").mapInArrow(
        read, f"{key} long, start long, n_tokens long, {name} {kind}")


def token_folder(spark) -> str:
    return scratch_path(spark, "token-ids")
