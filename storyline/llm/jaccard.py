"""Exact n-gram Jaccard join: all links at a threshold, as one class per row.

A text's set holds the 64-bit hashes of its distinct shingles.  Texts with the
same set are one node; its number is the first 64 bits of the set's digest.

*Candidates.*  In one order of all shingles, two sets of similarity t or more
share a shingle among the first (1 - t) n + 1 of each.  Only these travel, keyed
by shingle.  The order puts shingles that many texts share last, the most common
at the end (a bounded list found by counting every task's shingles), so a common
passage rarely brings texts together.  A shingle's texts form tiles of neighbouring sizes; sizes and
positions bound the overlap of two texts from above.

*Hot groups.*  In a small group all pairs are candidates.  In a larger one each
text is paired with the first of its tile and of the tile before.  Pairs that
pass link their texts.  Then members outside a group's largest class are paired
with sixteen of that class, and what is still in different classes with each
other.  So no link between classes is lost, while a group of copies gives a few
pairs per text.

*Verification.*  A pair is checked by bitmap signatures first: a bit set in one
signature and not in the other is a shingle without partner, so bit counts bound
the overlap from above.  Before all pairs between classes are looked at,
members bring their signatures along, so of these pairs only such leave the group.  What is left
is counted exactly by intersecting the two sorted arrays.

Null and empty texts have no set and no link.  Fewer words than a shingle are one
shingle.  Rows may repeat; each gives its own row.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import passing
from .rows import IdFilter, Steps, components, shuffle_width
from .words import bytes_of, join_hashes, mix, packed, ranges, slices, split_words, u64

_HOT = 1 << 20  # shingles in the list of hot ones at most: 8 MB
_COUNTED = 1 << 22  # shingles that a task counts at once
_NAMED = 64  # a task names one of so many shingles that it sees at most, or a thousand
_LEAST = 4  # texts that have a hot shingle, of those counted
_SMALL = 4  # texts of a group of which all pairs are candidates
_HEADS = 16  # members of a tile's largest class that others are held against before all are
_GROUP_ROWS = 1 << 16
_SIGNED_ROWS = 1 << 13  # of rows with signatures


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, where each text's begin, and each text's number of words."""
    words = split_words(data, offsets, lower=True)
    hashes = words.hashes()
    count = np.diff(words.first)
    per_text = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = ranges(words.first[:-1], per_text)
    text = np.repeat(np.arange(words.texts), per_text)
    values = join_hashes(hashes, n)[at] if len(hashes) else np.zeros(0, np.uint64)
    for t in np.flatnonzero((count > 0) & (count < n)):
        short = np.full(1, count[t], np.uint64)
        for h in hashes[words.first[t]:words.first[t + 1]]:
            short = mix(short * u64(0x9E3779B97F4A7C15) + h)
        values[np.searchsorted(text, t)] = short[0]
    edges = np.cumsum(np.concatenate([[0], per_text]))
    for a, b in zip(edges[:-1], edges[1:]):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(words.texts + 1)), count


def _nodes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    raw = values.view(np.uint8)
    return np.fromiter((int.from_bytes(hashlib.blake2b(raw[8 * a:8 * b], digest_size=8).digest(), "little", signed=True)
                        for a, b in zip(first[:-1], first[1:])), np.int64, len(first) - 1)


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles a set must show: size - ceil(t size) + 1."""
    return size - -(-size * percent // 100) + 1


def _least_overlap(a, b, percent: int):
    """The least intersection with which sizes a and b reach the threshold."""
    return -(-(a + b) * percent // (100 + percent))


class _Frequent:
    """Shingles that texts of a task share; of equally frequent ones those first in order are named first."""

    def __init__(self):
        self.kept, self.counts, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.waiting: list[np.ndarray] = []
        self.rows = 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.rows += len(values)
        self.seen += len(values)
        if self.rows >= _COUNTED:
            self._count()

    def _count(self) -> None:
        values, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        often = times > 1  # what occurs once in so many is forgotten
        kept, where = np.unique(np.concatenate([self.kept, values[often]]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, times[often]]), len(kept)).astype(np.int64)
        self.kept, self.waiting, self.rows = kept, [], 0

    def batch(self) -> pa.RecordBatch:
        self._count()
        most = np.lexsort((self.kept, -self.counts))[:max(1024, self.seen // _NAMED)]
        return _described(shingle=pa.array(self.kept[most].view(np.int64)), times=pa.array(self.counts[most]))


_DESCRIBED = ("__rid long, __key long, node long, n_shingles long, n_words long, signature binary, "
              "shingle long, times long")


def _described(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``_DESCRIBED``; columns not given are null."""
    kinds = [c.split() for c in _DESCRIBED.split(", ")]
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[c] if c in columns else pa.nulls(rows, pa.binary() if kind == "binary" else pa.int64())
         for c, kind in kinds], names=[c for c, _ in kinds])


def _describe(work: DataFrame, n: int) -> DataFrame:
    """Every row's set, and after each task's rows the shingles that are frequent in them (rows with ``shingle``)."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for batch in slices(batches, "__text"):
            values, first, n_words = shingles(*bytes_of(batch.column("__text")), n)
            frequent.add(values)
            yield _described(
                __rid=batch.column("__rid"), __key=batch.column("__key"), node=pa.array(_nodes(values, first)),
                n_shingles=pa.array(np.diff(first)), n_words=pa.array(n_words),
                signature=pa.array([_signature(values[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary()))
        yield frequent.batch()

    return work.mapInArrow(describe, _DESCRIBED)


def _hot_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, sorted, and of each how many digits the number of texts counted has in base 2.

    A task forgets what it sees once among ``_COUNTED``, so a shingle that many texts share is found in some task,
    however the texts are dealt.  The list is bounded (the most frequent first); which shingles are on it changes the
    work but never the links.
    """
    hot = (described.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("n"))
           .filter(F.col("n") >= _LEAST).orderBy(F.desc("n"), "shingle").limit(_HOT)
           .select("shingle", F.length(F.bin("n")).alias("digits")).toArrow())
    values = hot.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], hot.column("digits").to_numpy()[order].astype(np.uint8)


def _digits(hot: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """How common the shingles are: 0 for those that are not hot."""
    table, digits = hot
    if not len(table):
        return np.zeros(len(values), np.uint8)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, digits[at], np.uint8(0))


def _contains(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _tokens(docs: DataFrame, text: str, n: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, node, place): the first shingles of every set; place is size << 32 | position."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values, first, _ = shingles(*bytes_of(batch.column(text)), n)
            nodes, size = _nodes(values, first), np.diff(first)
            _, one = np.unique(nodes, return_index=True)  # copies in one batch travel once
            chosen = np.zeros(len(nodes), bool)
            chosen[one] = True
            chosen &= size > 0
            owner = np.repeat(np.arange(len(nodes)), size)
            values = values[np.argsort(owner * 64 + _digits(hot, values), kind="stable")]
            count = np.where(chosen, _prefix(size, percent), 0)
            at = ranges(first[:-1], count)
            who = np.repeat(np.arange(len(nodes)), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[at].view(np.int64)), pa.array(nodes[who]),
                 pa.array(size[who] << 32 | (at - first[who]))], names=["shingle", "node", "place"])

    return docs.select(text).mapInArrow(emit, "shingle long, node long, place long")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that never end inside a group."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        table = pa.Table.from_batches(kept)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut).combine_chunks().to_batches()
        rows = len(table) - cut
        if not cut:  # a group larger than a table: look again when it has doubled
            rows = 0
    if kept:
        yield pa.Table.from_batches(kept)


def _may_link(size, at, i, j, percent):
    """Do sizes and positions allow enough overlap?"""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    left = np.minimum(size[i] - at[i], size[j] - at[j])
    return (small * 100 >= large * percent) & (left >= _least_overlap(small, large, percent))


def _across(start, count, size, at, root, node, percent, heads):
    """Pairs of members of a group, of neighbouring sizes and different classes.

    Members of the group's largest class are not paired with each other, so the
    work grows with the members outside it.  With ``heads``, these are paired with
    that many members of the largest class in each tile next to their size.
    """
    band = math.log(100 / percent) / 2
    for s, c in zip(start, count):
        sizes, roots = size[s:s + c], root[s:s + c]
        names, often = np.unique(roots, return_counts=True)
        largest = names[often.argmax()]
        others = np.flatnonzero(roots != largest)
        if not len(others):
            continue
        if heads:
            tile = np.floor(np.log(sizes) / band).astype(np.int64)
            inside = np.flatnonzero(roots == largest)
            inside = inside[np.lexsort((mix(node[s + inside].view(np.uint64)), at[s + inside], tile[inside]))]
            first = np.searchsorted(tile[inside], tile[inside])
            chosen = inside[np.arange(len(inside)) - first < heads]  # by tile, those with least of their own before
            low = np.searchsorted(tile[chosen], tile[others] - 1)
            high = np.searchsorted(tile[chosen], tile[others] + 1, "right")
        else:
            chosen = np.arange(c)
            low = np.searchsorted(sizes, -(-sizes[others] * percent // 100))
            high = np.searchsorted(sizes, sizes[others] * 100 // percent, "right")
        edges = np.searchsorted(np.cumsum(high - low), np.arange(0, int((high - low).sum()), 1 << 21), "left")
        for a, b in zip(edges, [*edges[1:], len(others)]):
            i, j = np.repeat(others[a:b], (high - low)[a:b]), chosen[ranges(low[a:b], (high - low)[a:b])]
            good = (roots[i] != roots[j]) & ((roots[j] == largest) | (j > i))
            yield s + i[good], s + j[good]


def _pairs_of(percent: int, classes: bool = False, heads: int = 0):
    """Candidate pairs of every shingle's group.

    Without classes: all pairs of small groups; of larger ones the stars of the
    tiles, and the members again as rows without ``b``.  With classes: pairs of
    members that are in different classes.
    """
    band = math.log(100 / percent) / 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "shingle", _SIGNED_ROWS if classes and not heads else _GROUP_ROWS):
            key = table.column("shingle").to_numpy()
            node, place = table.column("node").to_numpy(), table.column("place").to_numpy()
            size = place >> 32
            order = np.lexsort((node, size, key))
            key, node, place, size = key[order], node[order], place[order], size[order]
            root = table.column("root").to_numpy()[order] if classes else None
            fresh = np.ones(len(key), bool)  # copies of a set came once from every batch
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, place, size = key[fresh], node[fresh], place[fresh], size[fresh]
            at = place & 0xFFFFFFFF
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([start, [len(key)]]))
            of = np.repeat(np.arange(len(start)), count)
            found_a, found_b = [], []

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                good = _may_link(size, at, i, j, percent)
                found_a.append(np.minimum(node[i], node[j])[good])
                found_b.append(np.maximum(node[i], node[j])[good])

            members = np.zeros(0, np.int64)
            if classes:
                root = root[fresh]
                for i, j in _across(start, count, size, at, root, node, percent, heads):
                    keep(i, j)
            else:
                for step in range(1, _SMALL):
                    i = np.flatnonzero((count[of] <= _SMALL)[:-step] & (key[:-step] == key[step:]))
                    if not len(i):
                        break
                    keep(i, i + step)
                members = np.flatnonzero(count[of] > _SMALL)
                if len(members):
                    # the head shows the shared shingle earliest: it has the fewest of its own, so it is in the
                    # middle of near copies; ties go by hash, so shingles of the same copies agree on it
                    tile = np.floor(np.log(size[members]) / band).astype(np.int64)
                    mark = of[members] * 1_000_003 + tile
                    by_place = np.lexsort((mix(node[members].view(np.uint64)), at[members], mark))
                    tiles, head = np.unique(mark[by_place], return_index=True)
                    head = by_place[head]
                    keep(members, members[head[np.searchsorted(tiles, mark)]])
                    before = np.minimum(np.searchsorted(tiles, mark - 1), len(tiles) - 1)
                    has = tiles[before] == mark - 1
                    keep(members[has], members[head[before[has]]])
            both = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], 1), axis=0) \
                if found_a else np.zeros((0, 2), np.int64)
            both = both[both[:, 0] != both[:, 1]]
            if "signature" in table.column_names:
                both = both[_bounds(table, both, percent)]
            blank = np.zeros(len(both), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([blank, key[members]])), pa.array(np.concatenate([both[:, 0], node[members]])),
                 pa.array(np.concatenate([both[:, 1], place[members]])),
                 pa.array(np.concatenate([np.ones(len(both), bool), np.zeros(len(members), bool)]))],
                names=["shingle", "a", "b", "pair"])
    return pairs


_PAIR = "shingle long, a long, b long, pair boolean"


def _signature_width(size: int) -> int:
    """Bits of a signature: four per shingle, rounded up to a power of two; 64 to 8192."""
    return min(8192, max(64, 1 << (4 * size - 1).bit_length()))


def _signature(values: np.ndarray) -> bytes | None:
    if not len(values):
        return None
    width = _signature_width(len(values))
    bits = np.zeros(width, np.uint8)
    bits[(values >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(work: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, hashes) of the sets in ``pairs``, from one text for each.

    Texts are picked by a filter on their rows; a few others may pass and do no harm.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = IdFilter(nodes.join(ends, "node", "left_semi"), "__rid")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = (b.filter(pa.array(wanted.may_hold(b.column("slot").to_numpy()))) for b in batches)
        for batch in slices(chosen, "__text"):
            values, first, _ = shingles(*bytes_of(batch.column("__text")), n)
            node = _nodes(values, first)
            _, one = np.unique(node, return_index=True)
            one = np.sort(one)
            size = np.diff(first)[one]
            body = values[ranges(first[one], size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[one]), packed(body.view(np.uint8), np.concatenate([[0], np.cumsum(size * 8)]))],
                names=["node", "hashes"])

    return work.select("__text", IdFilter.slot("__rid").alias("slot")).mapInArrow(emit, "node long, hashes binary")


def _overlaps(table: pa.Table, names: tuple[str, str], i: np.ndarray, j: np.ndarray, sizes) -> np.ndarray:
    """The most that the sets of rows i and j can share, by their signatures in the columns ``names``."""
    columns = [table.column(c).combine_chunks() for c in names]
    bits = [8 * np.diff(bytes_of(c)[1]) for c in columns]
    out = np.zeros(len(i), np.int64)
    width = np.minimum(bits[0][i], bits[1][j])
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        for a in range(0, len(of), max(1, (1 << 25) // int(w))):
            part = of[a:a + max(1, (1 << 25) // int(w))]
            x, y = (_signatures(c, b, at[part], int(w)) for c, b, at in zip(columns, bits, (i, j)))
            out[part] = np.minimum(sizes[0][i[part]] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64),
                                   sizes[1][j[part]] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return out


def _signatures(column: pa.Array, bits: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The signatures of rows, folded to ``width`` bits: 64 to a number, one row each."""
    out = np.zeros((len(rows), width // 64), np.uint64)
    for own in np.unique(bits[rows]):
        at = np.flatnonzero(bits[rows] == own)
        data, _ = bytes_of(column.take(pa.array(rows[at])))
        out[at] = np.bitwise_or.reduce(data.view(np.uint64).reshape(len(at), -1, width // 64), axis=1)
    return out


def _bounds(table: pa.Table, pairs: np.ndarray, percent: int) -> np.ndarray:
    """May the pairs of nodes link, by the signatures in the table's rows?"""
    nodes, row = np.unique(table.column("node").to_numpy(), return_index=True)
    i, j = (row[np.searchsorted(nodes, pairs[:, k])] for k in (0, 1))
    size = table.column("place").to_numpy() >> 32
    return _overlaps(table, ("signature", "signature"), i, j, (size, size)) >= _least_overlap(size[i], size[j], percent)


def _bounded(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            every = np.arange(len(batch))
            keep = _overlaps(pa.Table.from_batches([batch]), ("signature_a", "signature_b"), every, every,
                             sizes) >= _least_overlap(*sizes, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return check


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch.column("hashes_a"), batch.column("hashes_b"))):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(_contains(y, x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return check


def _signed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their signatures."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"),
                            F.col("signature").alias(f"signature_{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(percent), "a long, b long")


def _verified(steps: Steps, work: DataFrame, nodes: DataFrame, bounded: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, written; ``bounded`` is dropped."""
    sets = steps.write(_sets(work, nodes, bounded, n))
    linked = steps.write(
        bounded.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
        .mapInArrow(_linked(percent), "a long, b long"))
    steps.drop(bounded, sets)
    return linked


def _classes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(__key, __rid, n_shingles, n_words, root) of every row; rows with one root are linked.  Without a set: no root."""
    work = docs.select(F.xxhash64(F.col(key), F.coalesce(text, F.lit(""))).alias("__rid"),
                       F.col(key).cast("long").alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))

    steps = Steps(docs.sparkSession)
    seen = steps.write(_describe(work, n))
    hot = _hot_shingles(seen)
    described = seen.filter("shingle is null").drop("shingle", "times")
    rows = described.drop("signature")
    # one row of each set stands for its copies; keys may be null, row hashes are not
    chosen = described.filter("n_shingles > 0").groupBy("node").agg(F.min("__rid").alias("__rid"))
    nodes = steps.write(described.join(chosen, ["node", "__rid"])
                        .select("node", "__rid", F.col("n_shingles").alias("size"), "signature")
                        .dropDuplicates(["node"]))
    width = shuffle_width(docs.sparkSession)
    found = steps.write(
        _tokens(work, "__text", n, percent, hot).repartition(width, "shingle").sortWithinPartitions("shingle")
        .mapInArrow(_pairs_of(percent), _PAIR))
    pairs = steps.write(_signed(found.filter("pair").select("a", "b").distinct(), nodes, percent))
    links = _verified(steps, work, nodes, pairs, n, percent)
    classes = components(links)
    members = found.filter("not pair").select("shingle", F.col("a").alias("node"), F.col("b").alias("place"))
    for heads in (_HEADS, 0):
        known = members.join(classes, "node", "left").select(
            "shingle", "node", "place", F.coalesce("root", "node").alias("root"))
        # a shingle whose members are all in one class has nothing left to say
        split = known.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        split = known.join(split.select("shingle"), "shingle", "left_semi")
        if not heads:  # all pairs: the members bring their signatures; a few with heads are bounded afterwards
            split = split.join(nodes.select("node", "signature"), "node")
        rest = (split.repartition(width, "shingle").sortWithinPartitions("shingle")
                .mapInArrow(_pairs_of(percent, True, heads), _PAIR).select("a", "b").distinct())
        rest = steps.write(_signed(rest, nodes, percent) if heads else rest)
        more = _verified(steps, work, nodes, rest, n, percent)
        joined = steps.write(links.union(more))
        steps.drop(links, more)
        links = joined
        classes = components(links)
    steps.drop(found, nodes, links)
    named = rows.filter("n_shingles > 0").join(classes, "node", "left").select(
        "__key", "__rid", "n_shingles", "n_words", F.coalesce("root", "node").alias("root"))
    return named.union(rows.filter("n_shingles = 0").select(
        "__key", "__rid", "n_shingles", "n_words", F.lit(None).cast("long").alias("root")))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                    percent: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row: the least key reachable by links."""
    named = _classes(docs, key, text, n, percent)
    least = named.filter("root is not null").groupBy("root").agg(F.min("__key").alias("component_id"))
    return named.join(least, "root", "left").select(
        F.col("__key").alias(key), "n_shingles",
        F.when(F.col("root").isNull(), F.col("__key")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                     percent: int = 80) -> DataFrame:
    """All columns; of linked rows only the one with the least key (null last), of repeated rows one.

    Rows without words are linked with nothing and stay.
    """
    steps = Steps(docs.sparkSession)
    named = steps.write(_classes(docs, key, text, n, percent).filter("root is not null"))
    first = named.groupBy("root").agg(F.min(F.struct(
        F.coalesce("__key", F.lit((1 << 63) - 1)).alias("k"), F.col("__rid").alias("rid"))).alias("first"))
    judged = named.groupBy("root", "__rid").agg(F.count("*").alias("times")).join(first, "root")
    # rows to look at: those that go, and the repeats of one that stays
    doubtful = steps.write(judged.select("__rid", (F.col("__rid") == F.col("first.rid")).alias("stays"), "times")
                           .filter("not stays or times > 1"))
    steps.drop(named)
    tagged = docs.withColumn("__rid", F.xxhash64(F.col(key), F.coalesce(text, F.lit("")))).withColumn(
        "__slot", IdFilter.slot("__rid"))
    wanted = IdFilter(doubtful, "__rid")
    clear = passing(tagged, wanted, False).select(*docs.columns)
    hit = passing(tagged, wanted, True).join(doubtful, "__rid", "left")
    once = hit.filter("stays").dropDuplicates(["__rid"]).select(*docs.columns)
    return clear.union(hit.filter("stays is null").select(*docs.columns)).union(once)
