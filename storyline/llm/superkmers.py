"""Removal of word windows that an earlier document already has.

A window of ``window`` words belongs to its minimiser, the four words with the
least hash in it.  Consecutive windows with one minimiser form a super-k-mer,
which travels as one packed string to the bucket of the minimiser; there its
windows are unpacked and sorted, and equal ones counted against the smallest key.

First only minimisers travel, and what occurs in a single row ends there.  Of
equal super-k-mers in one batch only those of the smallest key travel on, as the
others are already known to be repeats; so a passage that a third of all rows
share comes once from each batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import repeats as R
from .rows import IdFilter, Steps, shuffle_width
from .words import Words, bytes_of, join_hashes, packed, ranges, slices, split_words

_MINIMISER = 4
_STRINGS = 1 << 14


def _window_counts(words: Words, window: int) -> np.ndarray:
    return np.maximum(np.diff(words.first) - window + 1, 0)


def _minimisers(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 2 << 20):
            words = split_words(*bytes_of(batch.column("__text")))
            count = _window_counts(words, window)
            if not count.any():
                continue
            hashes = join_hashes(words.hashes(), _MINIMISER)
            places = R.least_places(hashes, window - _MINIMISER + 1)
            text, x, before, least = R.runs_of_anchors(places, words.first[:-1], count)
            minimiser, known = R.probes(hashes[x])
            yield pa.RecordBatch.from_arrays(
                [pa.array(minimiser.view(np.int64)), batch.column("__rid").take(pa.array(text)),
                 pa.array(R.pack_anchor(x - words.first[text], before, least)), pa.array(known)],
                names=["minimiser", "__rid", "anchor", "known"])
    return emit


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: the bytes, and where each word begins and ends."""
    size = words.end - words.start
    end = np.cumsum(size + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    out[ranges(end - size - 1, size)] = words.data[ranges(words.start, size)]
    return out, end - size - 1, end - 1


_STRING = "minimiser long, __ord long, __rid long, anchor long, packed binary, settled boolean"


def _super_kmers(window: int):
    names = ["minimiser", "__ord", "__rid", "anchor", "packed", "settled"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 2 << 20):
            words = split_words(*bytes_of(batch.column("__text")))
            hashes = join_hashes(words.hashes(), _MINIMISER)
            text_bytes, begin, finish = joined(words)
            raw = text_bytes.tobytes()
            lists = batch.column("anchors")
            anchors = lists.flatten().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            rid, key = batch.column("__rid").to_numpy()[text], batch.column("__ord").to_numpy()[text]
            at, before, least = R.unpack_anchor(anchors)
            x = words.first[text] + at
            for a in range(0, len(at), _STRINGS):
                part = slice(a, a + _STRINGS)
                strings = [raw[i:j] for i, j in zip(begin[(x - before)[part]], finish[(x - least)[part] + window - 1])]
                first: dict[tuple, int] = {}
                same = np.fromiter((first.setdefault((s, b), i) for i, (s, b) in enumerate(
                    zip(strings, before[part].tolist()))), np.int64, len(strings))
                smallest = np.full(len(strings), np.iinfo(np.int64).max)
                np.minimum.at(smallest, same, key[part])
                travels = key[part] == smallest[same]
                done = ~travels
                start, end = (at - before)[part][done], (at - least + window)[part][done]
                n, m = int(travels.sum()), int(done.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([hashes[x[part][travels]].view(np.int64), rid[part][done]])),
                    pa.array(np.concatenate([key[part][travels], key[part][done]])),
                    pa.array(np.concatenate([rid[part][travels], rid[part][done]])),
                    pa.array(np.concatenate([anchors[part][travels], start << 32 | end])),
                    pa.array([s for s, t in zip(strings, travels) if t] + [None] * m, pa.binary()),
                    pa.array(np.concatenate([np.zeros(n, bool), np.ones(m, bool)]))], names=names)
    return emit


def _counted(window: int):
    """Spans of windows whose words also start under a smaller key."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.whole_groups(batches, "minimiser", 1 << 15):
            settled = table.column("settled").to_numpy(zero_copy_only=False)
            done, rest = table.filter(pa.array(settled)), table.filter(pa.array(~settled))
            rid, spans = [done.column("__rid").to_numpy()], [done.column("anchor").to_numpy()]
            minimiser = rest.column("minimiser").to_numpy()
            same = np.zeros(len(minimiser) + 1, bool)
            same[1:-1] = minimiser[1:] == minimiser[:-1]
            rest = rest.filter(pa.array(same[1:] | same[:-1]))
            if len(rest):
                words = split_words(*bytes_of(rest.column("packed")))
                at, before, least = R.unpack_anchor(rest.column("anchor").to_numpy())
                key = rest.column("__ord").to_numpy()
                count = before - least + 1
                row = np.repeat(np.arange(len(rest)), count)
                content = join_hashes(words.hashes(), window)[ranges(words.first[:-1], count)]
                order = np.argsort(content, kind="stable")
                head = np.ones(len(order), bool)
                head[1:] = content[order[1:]] != content[order[:-1]]
                low = np.minimum.reduceat(key[row[order]], np.flatnonzero(head))
                late = np.zeros(len(order), bool)
                late[order] = key[row[order]] > low[np.cumsum(head) - 1]
                flags = np.zeros((len(rest), int(count.max())), bool)
                flags[row, ranges(np.zeros(len(rest), np.int64), count)] = late
                who, a, b = R.spans_of(flags)
                rid.append(rest.column("__rid").to_numpy()[who])
                start = (at - before)[who]
                spans.append((start + a) << 32 | (start + b + window))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid)), pa.array(np.concatenate(spans))],
                                             names=["__rid", "span"])
    return emit


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """All rows and columns, and the words of each text that no smaller key has in the same window.

    Removes every word covered by ``window`` consecutive words that also start
    under a smaller ``key`` (null is the smallest).  Adds ``__kept`` (the words
    left, joined by one space), ``__n_words`` and ``__n_removed``.  Null counts as
    empty; texts with fewer words are kept whole; rows with equal keys do not
    remove each other's words.
    """
    width = shuffle_width(docs.sparkSession)
    steps = Steps(docs.sparkSession)
    work = R.identified(docs, key, text)
    rows = work.select("__rid", "__text").mapInArrow(_minimisers(window), "minimiser long, __rid long, anchor long, known boolean")
    found = steps.write(R.repeated(rows, "minimiser", width).select("__rid", "anchor"))
    wanted = IdFilter(found.select("__rid").distinct(), "__rid")
    per_row = found.groupBy("__rid").agg(F.collect_set("anchor").alias("anchors"))
    candidates = R.passing(work, wanted, True).drop("__slot").join(per_row, "__rid")
    spans = steps.write(
        candidates.mapInArrow(_super_kmers(window), _STRING)
        .repartition(width, "minimiser").sortWithinPartitions("minimiser")
        .mapInArrow(_counted(window), "__rid long, span long"))
    steps.drop(found)

    def cut(texts: pa.Array, own: list[np.ndarray]) -> list[pa.Array]:
        words = split_words(*bytes_of(texts))
        stays = np.ones(len(words.start), bool)
        for t, spans in enumerate(own):
            if len(spans):
                start, end = R.merged(spans)
                stays[words.first[t] + ranges(start, end - start)] = False
        left = np.concatenate([[0], np.cumsum(stays)])[words.first]
        body, begin, finish = joined(Words(words.data, words.offsets, words.start[stays], words.end[stays], left))
        count = np.diff(left)
        has = count > 0
        # the space after a text's last word goes
        size = np.zeros(len(count), np.int64)
        size[has] = finish[left[1:][has] - 1] - begin[left[:-1][has]]
        source = np.zeros(len(count), np.int64)
        source[has] = begin[left[:-1][has]]
        kept = packed(body[ranges(source, size)], np.concatenate([[0], np.cumsum(size)]), pa.string())
        n_words = np.diff(words.first)
        return [kept, pa.array(n_words), pa.array(n_words - count)]

    return R.cut_spans(docs, key, text, spans, cut, [
        T.StructField("__kept", T.StringType()), T.StructField("__n_words", T.LongType()),
        T.StructField("__n_removed", T.LongType())])
