"""What byte-wise and word-wise removal of repeated passages share.

Both judge windows of a fixed length.  Each window names an *anchor*: the place
with the least hash near its start, so equal windows name equal places and
consecutive windows mostly name the same one.  Only anchors whose surroundings
occur again are looked at further, and for each of these one string with all its
windows travels to where its repeats are.

A row is known by a hash of its key and text (``__rid``); rows that agree in both
are copies of each other and get the same result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .rows import IdFilter
from .words import mix, ranges, slices

GROUP_ROWS = 1 << 13
_ORDER = np.uint64(0xFFFFFFFF00000000)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__rid, __slot, __ord, __text) of every row."""
    rid = F.xxhash64(F.col(key), F.coalesce(text, F.lit("")))
    return (docs.select(rid.alias("__rid"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__ord"),
                        F.coalesce(text, F.lit("")).alias("__text"))
            .withColumn("__slot", IdFilter.slot("__rid")))


def least_places(order: np.ndarray, width: int) -> np.ndarray:
    """For every start, the place with the least value among ``width`` from it on (the leftmost of equals)."""
    best = (order & _ORDER) | np.arange(len(order), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[:len(best) - (width - reach)], best[width - reach:])
    return (best & ~_ORDER).astype(np.int64)


def runs_of_anchors(places: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Group each text's windows by anchor.

    ``first`` and ``count`` are the window starts of the texts.  Returns text,
    anchor and how far before the anchor the first and the last window start.
    """
    starts = ranges(first, count)
    texts = np.repeat(np.arange(len(first)), count)
    x = places[starts]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (texts[1:] != texts[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(x)]]) - 1 if len(head) else head
    return texts[head], x[head], x[head] - starts[head], x[head] - starts[tail]


def pack_anchor(at: np.ndarray, before: np.ndarray, least: np.ndarray) -> np.ndarray:
    return at << 24 | before << 12 | least


def unpack_anchor(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 24, packed >> 12 & 0xFFF, packed & 0xFFF


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = GROUP_ROWS) -> Iterator[pa.Table]:
    """Rows in which equal keys stand together, in tables that never end inside a group."""
    kept: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        kept.append(batch)
        waiting += len(batch)
        if waiting < rows:
            continue
        table = pa.Table.from_batches(kept)
        keys = table.column(key).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut)
            kept = table.slice(cut).to_batches()
        waiting = len(table) - cut if cut else 0  # a group larger than a table: look again after as many rows
    if kept:
        yield pa.Table.from_batches(kept)


def probes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys to shuffle the anchors of a batch by, and whether each is known to be repeated.

    Of equal keys in the batch one travels to its group; the others are known and
    go anywhere.  So a key that very many rows have comes once from each batch.
    """
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    known, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    known[order], later[order] = same[1:] | same[:-1], same[:-1]
    anywhere = mix(key ^ mix(np.arange(1, len(key) + 1, dtype=np.uint64)))
    return np.where(later, anywhere, key), known


def repeated(anchors: DataFrame, key: str, width: int) -> DataFrame:
    """The anchors whose ``key`` occurs more than once, or that are ``known`` to be repeated."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, 1 << 17):
            keys = table.column(key).to_numpy()
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            same = same[1:] | same[:-1] | table.column("known").to_numpy(zero_copy_only=False)
            yield from table.filter(pa.array(same)).combine_chunks().to_batches()

    return anchors.repartition(width, key).sortWithinPartitions(key).mapInArrow(pick, anchors.schema)


def passing(docs: DataFrame, wanted: IdFilter, inside: bool) -> DataFrame:
    """Rows that may be (or that are surely not) in the filter."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.may_hold(batch.column("__slot").to_numpy()) == inside))

    return docs.mapInArrow(pick, docs.schema)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of true values."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, begin = np.nonzero(step == 1)
    return row, begin, np.nonzero(step == -1)[1] - 1


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the packed spans (start << 32 | end) of one text."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    head = np.flatnonzero(new)
    return start[head], end[np.concatenate([head[1:], [len(start)]]) - 1]


def cut_spans(docs: DataFrame, key: str, text: str, spans: DataFrame, cut, added: list[T.StructField]) -> DataFrame:
    """All rows and columns of ``docs`` and the columns that ``cut`` adds.

    ``spans`` holds (__rid, span).  ``cut(texts, spans)`` gets an Arrow column and
    one array of packed spans per text.  Only texts that may have a span are moved.
    """
    tagged = docs.withColumn("__rid", F.xxhash64(F.col(key), F.coalesce(text, F.lit("")))).withColumn(
        "__slot", IdFilter.slot("__rid"))
    wanted = IdFilter(spans.select("__rid").distinct(), "__rid")
    per_row = spans.groupBy("__rid").agg(F.collect_set("span").alias("__spans"))
    hit = passing(tagged, wanted, True).join(per_row, "__rid", "left").drop("__rid", "__slot")
    schema = T.StructType([*docs.schema.fields, *added])
    names, columns = schema.names, docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            lists = batch.column("__spans")
            values, edges = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(
                np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
            own = [values[a:b] for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *cut(batch.column(text), own)], names=names)

    def apply_to_missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # picked and described by one worker: a second one would hold the same texts again
        none = np.zeros(0, np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(~wanted.may_hold(batch.column("__slot").to_numpy())))
            for part in slices([batch], text, 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], *cut(part.column(text), [none] * len(part))], names=names)

    return hit.select(*docs.columns, "__spans").mapInArrow(apply, schema).union(
        tagged.select(*docs.columns, "__slot").mapInArrow(apply_to_missed, schema))

