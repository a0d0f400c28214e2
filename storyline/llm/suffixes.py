"""Removal of byte strings that occur more than once, by sorting suffixes.

Every window of ``length`` bytes names an anchor in its first half.  The suffixes
that start at anchors are the ones sorted: splitters taken from their quantiles
deal them by leading bytes, and each bucket sorts its own by multikey sort, one
8-byte key after the other and only within ties.  Neighbours share the longest
common prefixes; the bytes before the anchors are sorted in the same way.  A
window that begins d bytes before its anchor is repeated when another suffix
agrees in ``length - d`` bytes after and in d bytes before the anchor.

Suffixes with equal leading bytes never lie in different buckets, so boundaries
between buckets need no comparison.  Copies within one batch travel once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import repeats as R
from .rows import IdFilter, Steps, shuffle_width
from .words import bytes_of, mix, ranges, slices, u64

_GRAM = 8
_SUFFIXES = 1 << 12  # strings that are held at once
_SIGN = u64(1 << 63)


class Shape:
    """How a window length is divided: where its anchor may lie and what surely follows the anchor."""

    def __init__(self, length: int):
        if not 64 <= length <= 4096:
            raise ValueError("length must be 64 to 4096 bytes")
        self.length = length
        self.width = length // 2 - _GRAM
        self.fixed = (length - self.width) // 8


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; the data's end reads as zeros."""
    padded = np.concatenate([data, np.zeros(_GRAM, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _content(eights: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """A hash of the ``8 * steps`` bytes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for i in range(steps):
        out = mix(out * u64(0x9E3779B97F4A7C15) + eights[at + 8 * i])
    return out


def _lead(eights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes, as a signed number in the bytes' order."""
    return (eights[at].byteswap() ^ _SIGN).view(np.int64)


def _anchors(shape: Shape):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            data, offsets = bytes_of(batch.column("__text"))
            windows = np.maximum(np.diff(offsets) - shape.length + 1, 0)
            if not windows.any():
                continue
            eights = _eights(data)
            places = R.least_places(mix(eights[:-1]), shape.width)
            text, x, before, least = R.runs_of_anchors(places, offsets[:-1], windows)
            content, known = R.probes(_content(eights, x, shape.fixed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(content.view(np.int64)), batch.column("__rid").take(pa.array(text)),
                 pa.array(R.pack_anchor(x - offsets[text], before, least)), pa.array(_lead(eights, x)), pa.array(known)],
                names=["content", "__rid", "anchor", "lead", "known"])
    return emit


def _strings(shape: Shape, splits: np.ndarray):
    """One string per anchor, with its bucket; windows of copies within the batch are settled at once."""
    names = ["bucket", "lead", "content", "__rid", "anchor", "bytes", "settled"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = bytes_of(batch.column("__text"))
            lists = batch.column("anchors")
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            packed = lists.flatten().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(batch)), count)
            rid = batch.column("__rid").to_numpy()[text]
            at, before, least = R.unpack_anchor(packed)
            eights = _eights(data)
            where = offsets[text] + at
            content = _content(eights, where, shape.fixed)
            lead = _lead(eights, where)
            bucket = np.searchsorted(splits, lead, "right")
            raw = data.tobytes()
            for a in range(0, len(at), _SUFFIXES):
                part = slice(a, a + _SUFFIXES)
                strings = [raw[i:j] for i, j in zip((where - before)[part], (where - least + shape.length)[part])]
                first: dict[tuple, int] = {}
                copies = np.fromiter((first.setdefault((s, b), i) for i, (s, b) in enumerate(
                    zip(strings, before[part].tolist()))), np.int64, len(strings))
                twice = np.bincount(copies, minlength=len(strings)) > 1
                travels = copies == np.arange(len(strings))
                done = twice[copies]
                # settled rows carry their span in place of the anchor
                start, end = (at - before)[part][done], (at - least + shape.length)[part][done]
                n, m = int(travels.sum()), int(done.sum())
                zero = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([bucket[part][travels], rid[part][done] & 0xFFFF])),
                    pa.array(np.concatenate([lead[part][travels], zero])),
                    pa.array(np.concatenate([content[part][travels].view(np.int64), zero])),
                    pa.array(np.concatenate([rid[part][travels], rid[part][done]])),
                    pa.array(np.concatenate([packed[part][travels], start << 32 | end])),
                    pa.array([s for s, t in zip(strings, travels) if t] + [None] * m, pa.binary()),
                    pa.array(np.concatenate([np.zeros(n, bool), np.ones(m, bool)]))], names=names)
    return emit


_STRING = "bucket long, lead long, content long, __rid long, anchor long, bytes binary, settled boolean"


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte rows: by eight bytes at a time, each only within ties of those before."""
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(keys[order[1:], 0] != keys[order[:-1], 0])
    for column in range(1, keys.shape[1]):
        same = group[1:] == group[:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value = keys[order[at], column]
        inner = np.lexsort((value, group[at]))
        order[at], value = order[at[inner]], value[inner]
        # places of a group stay together, so only differences inside it start a new one
        new = np.zeros(len(order), np.int64)
        new[at[1:]] = (group[at[1:]] == group[at[:-1]]) & (value[1:] != value[:-1])
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it in the order."""
    differ = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[-1], shared])


def repeated_windows(strings: pa.Array, before: np.ndarray, least: np.ndarray, shape: Shape) -> np.ndarray:
    """For every string and distance d: does the window d bytes before its anchor occur again?"""
    m = len(before)
    data, offsets = bytes_of(strings)
    right = np.zeros((m, -(-shape.length // 8) * 8), np.uint8)
    left = np.zeros((m, -(-shape.width // 8) * 8), np.uint8)
    size = shape.length - least
    right[np.repeat(np.arange(m), size), ranges(np.zeros(m, np.int64), size)] = data[ranges(offsets[:-1] + before, size)]
    back = ranges(np.ones(m, np.int64), before)
    left[np.repeat(np.arange(m), before), back - 1] = data[np.repeat(offsets[:-1] + before, before) - back]
    orders = multikey_order(right), multikey_order(left)
    shared = _common(right, orders[0]), _common(left, orders[1])
    flags = np.zeros((m, int(before.max()) + 1), bool)
    classes = np.empty((2, m), np.int64)
    for d in range(flags.shape[1]):
        rows = np.flatnonzero((least <= d) & (d <= before))
        if len(rows) < 2:
            continue
        classes[0, orders[0]] = np.cumsum(shared[0] < shape.length - d)
        classes[1, orders[1]] = np.cumsum(shared[1] < d)
        both = classes[0, rows] * (m + 1) + classes[1, rows]
        order = np.argsort(both)
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = both[order[1:]] == both[order[:-1]]
        flags[rows[order], d] = same[1:] | same[:-1]
    return flags


def _resolve(shape: Shape):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.whole_groups(batches, "content"):
            settled = table.column("settled").to_numpy(zero_copy_only=False)
            done = table.filter(pa.array(settled))
            rid, spans = [done.column("__rid").to_numpy()], [done.column("anchor").to_numpy()]
            rest = table.filter(pa.array(~settled))
            content = rest.column("content").to_numpy()
            same = np.zeros(len(content) + 1, bool)
            same[1:-1] = content[1:] == content[:-1]
            rest = rest.filter(pa.array(same[1:] | same[:-1]))
            if len(rest):
                at, before, least = R.unpack_anchor(rest.column("anchor").to_numpy())
                row, low, high = R.spans_of(repeated_windows(rest.column("bytes").combine_chunks(), before, least, shape))
                rid.append(rest.column("__rid").to_numpy()[row])
                spans.append((at[row] - high) << 32 | (at[row] - low + shape.length))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid)), pa.array(np.concatenate(spans))],
                                             names=["__rid", "span"])
    return emit


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
                          as_text: bool = False) -> DataFrame:
    """All rows and columns, and what is left of each text without repeated bytes.

    Removes every byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same text or another.  Adds ``__kept`` (binary; cuts may
    split a character), ``__n_bytes``, ``__n_removed`` and ``__n_spans`` (maximal
    removed runs).  With ``as_text`` the kept bytes are a string instead, without the
    parts of characters that were cut.  Null counts as empty; shorter texts are kept whole; repeated
    rows are repeats of each other.
    """
    shape, width = Shape(length), shuffle_width(docs.sparkSession)
    steps = Steps(docs.sparkSession)
    work = R.identified(docs, key, text)
    anchors = work.select("__rid", "__text").mapInArrow(
        _anchors(shape), "content long, __rid long, anchor long, lead long, known boolean")
    found = steps.write(R.repeated(anchors, "content", width).select("__rid", "anchor", "lead"))
    n = 2 * width
    splits = found.agg(F.percentile_approx("lead", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0] or []
    wanted = IdFilter(found.select("__rid").distinct(), "__rid")
    per_row = found.groupBy("__rid").agg(F.collect_set("anchor").alias("anchors"))
    candidates = R.passing(work.select("__rid", "__slot", "__text"), wanted, True).join(per_row, "__rid")
    spans = steps.write(
        candidates.select("__rid", "__text", "anchors")
        .mapInArrow(_strings(shape, np.array(sorted(set(splits)), np.int64)), _STRING)
        .repartition(width, "bucket").sortWithinPartitions("lead", "content")
        .mapInArrow(_resolve(shape), "__rid long, span long"))
    steps.drop(found)

    def cut(texts: pa.Array, own: list[np.ndarray]) -> list[pa.Array]:
        data, offsets = bytes_of(texts)
        kept, removed, runs = [], [], []
        for t, spans in enumerate(own):
            body = data[offsets[t]:offsets[t + 1]]
            if len(spans):
                start, end = R.merged(spans)
                stays = np.ones(len(body), bool)
                stays[ranges(start, end - start)] = False
                body = body[stays]
                runs.append(len(start))
            else:
                runs.append(0)
            kept.append(body.tobytes().decode(errors="ignore") if as_text else body.tobytes())
            removed.append(int(offsets[t + 1] - offsets[t]) - len(body))
        return [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64())]

    return R.cut_spans(docs, key, text, spans, cut, [
        T.StructField("__kept", T.StringType() if as_text else T.BinaryType()), T.StructField("__n_bytes", T.LongType()),
        T.StructField("__n_removed", T.LongType()), T.StructField("__n_spans", T.LongType())])
