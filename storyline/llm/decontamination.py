"""Passages of benchmark items in documents, by SimHash windows.

A document is read in windows of the size of an item.  Window and item have a
64-bit SimHash of their word shingles.  Fingerprints within ``RADIUS`` bits of
each other agree in at least one of ``RADIUS + 1`` blocks, so looking up every
block of a window finds all items within the radius.  Each candidate is verified
by the exact weighted Jaccard similarity of the shingles, a shingle weighing the
logarithm of how few items have it; the best item and window of a passage stay.

A window without any shingle of an item cannot be similar to one, so only windows
that line up with a shared shingle are fingerprinted; nothing is lost by that.

Words are split at blanks and ASCII punctuation, A-Z in lower case.  Items of
fewer words than a shingle are too short to tell and are not searched.  Null
counts as empty.  Items are taken in slices of bounded size, so their number has
no limit.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import IN_TERM, bytes_of, join_hashes, mix, ranges, slices, split_words, windows

RADIUS = 19
_SLICE_BYTES = 8 << 20  # text of items that is looked for at once
_TABLE_BITS = 20


def simhash(values: np.ndarray, weights: np.ndarray) -> int:
    """Bit b is set where the weights of shingles with and without it sum above zero."""
    bits = np.unpackbits(mix(values).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(weights @ (2.0 * bits - 1) > 0, bitorder="little").tobytes(), "little")


def blocks(fingerprint: int) -> list[tuple[int, int]]:
    """The fingerprint cut into ``RADIUS + 1`` numbered blocks."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(i, fingerprint >> a & ((1 << (b - a)) - 1)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


class Items:
    """The items of one slice, indexed by shingle and by fingerprint block."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.n = n
        words = split_words(*bytes_of(pa.array(texts, pa.string())), lower=True, inside=IN_TERM)
        hashes = join_hashes(words.hashes(), n)
        self.ids, self.size, self.shingles = [], [], []
        for t, item in enumerate(ids):
            a, b = words.first[t], words.first[t + 1]
            if b - a >= n:
                self.ids.append(item)
                self.size.append(int(b - a))
                self.shingles.append(hashes[a:b - n + 1])
        every = np.concatenate([np.unique(s) for s in self.shingles]) if self.shingles else np.zeros(0, np.uint64)
        self.known, count = np.unique(every, return_counts=True)
        self.weight = 1 + np.log((1 + len(self.ids)) / count)
        self.default = 1 + np.log(1 + len(self.ids))
        # where every shingle stands in which item
        flat = np.concatenate(self.shingles) if self.shingles else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.shingles])
        place = ranges(np.zeros(len(self.ids), np.int64), np.array([len(s) for s in self.shingles], np.int64))
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order], place[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[(self.known & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        self.prints = [simhash(s, self.weights(s)) for s in self.shingles]
        self.index: dict[tuple, list[int]] = {}
        for i, fingerprint in enumerate(self.prints):
            for block in blocks(fingerprint):
                self.index.setdefault((self.size[i], *block), []).append(i)

    def weights(self, values: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(values), self.default)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        return np.where(self.known[at] == values, self.weight[at], self.default)

    def seeds(self, hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, item, place in the item) of every shingle that an item has."""
        at = np.flatnonzero(valid & self.maybe[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.flat, hashes[at]), np.searchsorted(self.flat, hashes[at], "right")
        of = ranges(low, high - low)
        return np.repeat(at, high - low), self.owner[of], self.place[of]

    def within(self, fingerprint: int, size: int) -> set[int]:
        found: set[int] = set()
        for block in blocks(fingerprint):
            found.update(self.index.get((size, *block), ()))
        return {i for i in found if (self.prints[i] ^ fingerprint).bit_count() <= RADIUS}

    def similarity(self, window: np.ndarray, item: int) -> float:
        a, b = np.unique(window), np.unique(self.shingles[item])
        both = np.intersect1d(a, b, assume_unique=True)
        shared = self.weights(both).sum()
        return float(shared / (self.weights(a).sum() + self.weights(b).sum() - shared))


def _best_windows(batch: pa.RecordBatch, text: str, items: Items, threshold: float) -> dict[tuple[int, int], tuple]:
    """(row, item) to (start, words, similarity) of the best window that reaches the threshold."""
    n = items.n
    words = split_words(*bytes_of(batch.column(text)), lower=True, inside=IN_TERM)
    hashes = join_hashes(words.hashes(), n)
    at, item, place = items.seeds(hashes, windows(words, n))
    if not len(at):
        return {}
    row = np.searchsorted(words.first, at, "right") - 1
    size = np.array(items.size, np.int64)[item]
    # item-sized windows in line with a seed, inside their text
    last = np.maximum(words.first[row + 1] - size, words.first[row])
    start = np.clip(at - place, words.first[row], last)
    best: dict[tuple[int, int], tuple] = {}
    for t, s, width in np.unique(np.stack([row, start, size], 1), axis=0).tolist():
        end = min(s + width, int(words.first[t + 1]))
        own = hashes[s:end - n + 1]
        for i in items.within(simhash(own, items.weights(own)), width):
            similar = items.similarity(own, i)
            if similar >= threshold and ((t, i) not in best or similar > best[t, i][2]):
                best[t, i] = (s - int(words.first[t]), end - s, similar)
    return best


def _search(items: Items, threshold: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            best = _best_windows(batch, "__text", items, threshold)
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key").take(pa.array([t for t, _ in keys], pa.int64())),
                 pa.array([items.ids[i] for _, i in keys], pa.int64()),
                 *[pa.array([best[k][c] for k in keys], kind)
                   for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]],
                names=["__key", "item_id", "start_word", "n_words", "similarity"])
    return emit


def _without(items: Items, text: str, threshold: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            stays = np.ones(len(batch), bool)
            stays[[t for t, _ in _best_windows(batch, text, items, threshold)]] = False
            yield batch.filter(pa.array(stays))
    return emit


def _slices_of(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in slices of bounded text; one slice is held at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), "text").filter(
        "i is not null and text is not null").orderBy("i", "text")
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.text)
        size += len(row.text)
        if size >= _SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
               threshold: float = 0.8) -> DataFrame:
    """``(key, item_id, start_word, n_words, similarity)``: the best window of each item found in each row."""
    work = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    schema = "__key long, item_id long, start_word long, n_words long, similarity double"
    found = None
    for ids, texts in _slices_of(benchmark):
        part = work.mapInArrow(_search(Items(ids, texts, n), threshold), schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("__key", key)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 5,
                  threshold: float = 0.8) -> DataFrame:
    """The rows, with all columns, in which no item is found."""
    schema = docs.schema
    for ids, texts in _slices_of(benchmark):
        docs = docs.mapInArrow(_without(Items(ids, texts, n), text, threshold), schema)
    return docs
