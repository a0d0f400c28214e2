"""Phrases whose words stand together more often than their parts would.

Phrases are counted by sorting suffixes.  A suffix is a pointer to a word; its key
are the words from there to the end of its piece, ``max_words`` at most.  Suffixes
are routed by their two leading words, so that every phrase meets in one bucket,
and each bucket is sorted by multikey three-way quicksort to the full depth: the
suffixes equal to the pivot at a depth are all occurrences of one phrase, and
their number is its count.  A part that holds fewer suffixes than a phrase needs
is given up.  Words are counted before, so a suffix ends at its first rare word
and suffixes of rare words do not travel.

Suffixes that are equal within a batch of texts travel as one with a weight.  A
pair of two very frequent words may still have more different continuations than
one bucket should hold; its suffixes are routed by the whole key, and the parts of
its count are summed afterwards.

Null languages are ``und``; null texts are empty.  Repeated rows count as often as
they occur; without any phrase the result is empty.  Columns other than the text
and the language are not read, so their names cannot clash.  Words are told apart
by a 64-bit hash of language and bytes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .rows import Steps, shuffle_width
from .words import bytes_of, mix, packed, slices, split_words, u64

BUCKET_ROWS = 1 << 19      # suffixes in one bucket, on average
_BATCH = 8 << 20           # bytes of text whose equal suffixes travel as one
_MOST_BITS = 28            # 32 MB
_LEAST_BITS = 20

_CUTS = np.frombuffer(b".,;:!?\x0A\x0B\x0C\x0D", np.uint8)
_IN_WORD = np.ones(256, bool)
_IN_WORD[_CUTS] = False
_IN_WORD[[0x20, 0x09]] = False
_IS_CUT = np.zeros(256, np.int32)
_IS_CUT[_CUTS] = 1


class BitFilter:
    """A set of 64-bit hashes as bits; never wrong about one that is in it.

    Its size follows the number of hashes (16 bits each, so one in sixteen others
    passes) up to 32 MB; beyond that more of the others pass, which costs time only.
    """

    def __init__(self, hashes: DataFrame, column: str, count: int):
        self.shift = np.uint64(64 - min(_MOST_BITS, max(_LEAST_BITS, (16 * count).bit_length())))
        n = 64 - int(self.shift)
        slot = F.shiftrightunsigned(F.col(column), int(self.shift))
        words = (hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")))
        self.bits = np.zeros(1 << (n - 6), np.uint64)
        got = words.toArrow()  # 2**22 rows at most
        if got.num_rows:
            self.bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        s = hashes >> self.shift
        return (self.bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) > 0


def _words(batch: pa.RecordBatch):
    """Words of a batch of (lang, text), their hashes with language, and which follow within a piece."""
    data, offsets = bytes_of(batch.column("text"))
    words = split_words(data, offsets, lower=True, inside=_IN_WORD)
    langs = batch.column("lang").dictionary_encode()
    names = split_words(*bytes_of(langs.dictionary), inside=np.ones(256, bool))
    salt = np.zeros(len(langs.dictionary), np.uint64)
    salt[np.diff(names.first) > 0] = names.hashes()  # an empty name keeps 0
    number = langs.indices.to_numpy()
    text = words.text_of()
    ids = mix(words.hashes() + salt[number[text]] * u64(0x9E3779B97F4A7C15))
    ids[ids == 0] = 1
    cuts = np.cumsum(_IS_CUT[words.data])[words.start] if len(words.start) else np.zeros(0, np.int32)
    follows = np.zeros(len(ids) + 1, bool)  # word i + 1 stands in the same piece as word i
    follows[:-2] = (text[1:] == text[:-1]) & (cuts[1:] == cuts[:-1])
    return words, ids, follows, langs.dictionary, number[text]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each different key, and how often it occurs."""
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[head], np.diff(np.append(head, len(key)))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, id, f) of every word of ``docs`` (lang, text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            words, ids, _, langs, lang = _words(batch)
            at, n = _groups(ids)
            lengths = words.end[at] - words.start[at]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            spread = np.repeat(words.start[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang[at])), packed(words.data[spread], offsets, pa.string()),
                 pa.array(ids[at].view(np.int64)), pa.array(n)], names=["lang", "word", "id", "f"])

    rows = docs.mapInArrow(count, "lang string, word string, id long, f long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _suffixes(docs: DataFrame, frequent: BitFilter, hot: BitFilter, depth: int) -> DataFrame:
    """(deep, w0 ... , n): the different suffixes of each batch that begin with two frequent words."""
    names = [f"w{d}" for d in range(depth)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            _, ids, follows, _, _ = _words(batch)
            good = np.concatenate([frequent.may_hold(ids), np.zeros(depth, bool)])
            wide = np.concatenate([ids, np.zeros(depth, np.uint64)])
            start = np.flatnonzero(good[:len(ids)] & follows[:-1] & good[1:len(ids) + 1])
            keys, alive = [wide[start], wide[start + 1]], np.ones(len(start), bool)
            for d in range(2, depth):
                alive = alive & follows[np.minimum(start + d - 1, len(ids))] & good[start + d]
                keys.append(np.where(alive, wide[start + d], np.uint64(0)))
            whole = keys[0]
            for key in keys[1:]:
                whole = mix(whole * u64(0xD1342543DE82EF95) + key)
            at, n = _groups(whole)
            deep = hot.may_hold(keys[0][at]) & hot.may_hold(keys[1][at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(deep), *[pa.array(key[at].view(np.int64)) for key in keys], pa.array(n)],
                names=["deep", *names, "n"])

    return docs.mapInArrow(emit, "deep boolean, " + ", ".join(f"{n} long" for n in names) + ", n long")


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: Sequence[int]):
    """Multikey three-way quicksort of the rows of ``keys``; yields (depth, row, sum of weights).

    All parts are split at once, each around the key of its middle row at its own
    depth.  The rows equal to the pivot are one partition of that depth: it is
    yielded with the sum of its weights, and goes on one word deeper.
    A part below the ``least`` of its depth cannot hold such a partition and is
    given up.  A key of 0 ends a row.
    """
    least, width = np.asarray(least), keys.shape[1]
    flat = np.ascontiguousarray(keys).ravel()
    rows = np.arange(len(keys))
    sizes, depths = np.array([len(rows)]), np.array([0])
    while len(rows):
        begin = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weight[rows], begin)
        keep = total >= least[depths]
        if not keep.all():
            rows, sizes, depths = rows[np.repeat(keep, sizes)], sizes[keep], depths[keep]
            if not len(rows):
                return
            begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        key = flat[rows * width + depths[part]]
        pivot = key[begin + sizes // 2][part]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # a stable three-way split of every part by counting
        counts = np.zeros((len(sizes), 3), np.int64)
        place = np.empty(len(rows), np.int64)
        flags = [side == s for s in range(3)]
        for s, flag in enumerate(flags):
            counts[:, s] = np.add.reduceat(flag, begin, dtype=np.int64)
        starts = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(-1, 3)
        for s, flag in enumerate(flags):
            # those of this side lie in order of their parts, so their places are ranges
            place[flag] = np.repeat(starts[:, s] - (np.cumsum(counts[:, s]) - counts[:, s]), counts[:, s]) \
                + np.arange(int(flag.sum()))
        moved = np.empty(len(rows), rows.dtype)
        moved[place] = rows
        rows = moved
        running = np.concatenate([[0], np.cumsum(weight[rows])])
        equal = starts[:, 1]  # every part has a row equal to its pivot
        yield depths + 1, rows[equal], running[equal + counts[:, 1]] - running[equal]
        sizes = counts.ravel()
        depths = (depths[:, None] + np.array([0, 1, 0])).ravel()
        deeper = np.arange(len(sizes)) % 3 == 1
        alive = np.ones(len(rows), bool)
        part = np.repeat(np.arange(len(sizes)), sizes)
        inside = deeper[part]
        last = inside & (depths[part] >= width)
        alive[last] = False
        more = np.flatnonzero(inside & ~last)
        alive[more] = flat[rows[more] * width + depths[part[more]]] != 0
        sizes = np.bincount(part[alive], minlength=len(sizes))
        rows = rows[alive]
        depths, sizes = depths[sizes > 0], sizes[sizes > 0]


def _sorted_buckets(suffixes: DataFrame, least: int, depth: int, width: int) -> DataFrame:
    """(ws, f): parts of the counts of the phrases of two words and more."""
    names = [f"w{d}" for d in range(depth)]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # one bucket
        if not got:
            return
        table = pa.Table.from_batches(got)
        got.clear()
        deep = table.column("deep").to_numpy()
        keys = np.stack([table.column(n).to_numpy().view(np.uint64) for n in names], axis=1)
        weight = table.column("n").to_numpy()
        del table
        # parts of a deep phrase's count lie in several buckets, except at full depth
        for rows, bound in ((np.flatnonzero(~deep), [least] * depth),
                            (np.flatnonzero(deep), [0] * (depth - 1) + [least])):
            mine, own = keys[rows], weight[rows]
            for depths, at, sums in equal_partitions(mine, own, bound):
                ok = (depths > 1) & (sums >= np.asarray(bound)[depths - 1])
                if not ok.any():
                    continue
                d, values = depths[ok], mine[at[ok]]
                inside = np.arange(depth) < d[:, None]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(d)]).astype(np.int32)),
                    pa.array(values[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(sums[ok])], names=["ws", "f"])

    route = F.when(F.col("deep"), F.xxhash64(*names)).otherwise(F.xxhash64("w0", "w1"))
    return suffixes.repartition(width, route).mapInArrow(sort, "ws array<long>, f long")


def count_phrases(docs: DataFrame, words: DataFrame, least: int, max_words: int, hot_from: int = BUCKET_ROWS // 2,
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(ws, f) of all phrases of 2 to ``max_words`` words that occur ``least`` times; ``ws`` are word ids.

    ``words`` is a stored ``count_words(docs)``.
    """
    total, frequent, hot = words.agg(F.sum("f"), F.count_if(F.col("f") >= least),
                                     F.count_if(F.col("f") >= hot_from)).first()
    suffixes = _suffixes(docs, BitFilter(words.filter(F.col("f") >= least), "id", frequent),
                         BitFilter(words.filter(F.col("f") >= hot_from), "id", hot), max_words)
    width = max(shuffle_width(docs.sparkSession), -(-(total or 0) // bucket_rows))
    parts = _sorted_buckets(suffixes, least, max_words, width)
    return parts.groupBy("ws").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a**2 / (l r)), exact while a is below 10**15."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    above = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    below = (wide[1] * wide[2]).cast("decimal(38,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), below)


def mine_phrases(docs: DataFrame, top: int, *, text: str = "text", lang: str = "lang", least: int = 10,
                 max_words: int = 3, share: int = 50) -> DataFrame:
    """The ``top`` phrases of each language by association of their parts.

    A phrase of 2 to ``max_words`` words is a candidate if it occurs ``least`` times.
    Its score is 10**6 a**2 / (l r), rounded down, at the cut between its words where
    that is least (the first of such cuts).  A candidate inside a longer one that
    occurs at least ``share`` hundredths as often is left out.

    Returns (lang, rank, phrase, a, l, r, n, score), n being the words of the language.
    """
    steps = Steps(docs.sparkSession)
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = steps.write(count_words(docs))
    phrases = steps.write(count_phrases(docs, words, least, max_words))
    known = phrases.union(words.filter(F.col("f") >= least).select(F.array("id"), "f"))

    longer = phrases.filter(F.size("ws") > 2).select("ws", "f", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("m"))
    inside = (longer.select("ws", "f", "m", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1)).alias("i"))
              .groupBy(F.slice("ws", F.col("i"), F.col("m")).alias("ws")).agg(F.max("f").alias("in_longer")))
    kept = phrases.join(inside, "ws", "left").filter(
        F.coalesce(100 * F.col("in_longer") < share * F.col("f"), F.lit(True))).drop("in_longer")

    def counts(part: str, count: str) -> DataFrame:
        return known.select(F.col("ws").alias(part), F.col("f").alias(count))

    cuts = kept.select("ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = (cuts.withColumns({"first": F.slice("ws", F.lit(1), F.col("k")),
                              "rest": F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k"))})
            .join(counts("first", "l"), "first").join(counts("rest", "r"), "rest"))
    scored = (cuts.groupBy("ws", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
                                                         "k", "l", "r")).alias("cut"))
              .select("ws", "a", "cut.score", "cut.l", "cut.r"))
    named = words.select("id", "lang", "word")
    ranked = scored.join(named.select(F.col("id").alias("id"), "lang"), F.element_at("ws", 1) == F.col("id")).drop("id")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = ranked.withColumn("rank", F.rank().over(best)).filter(F.col("rank") <= top)
    spelt = (ranked.select("*", F.posexplode("ws").alias("i", "id")).join(named.select("id", "word"), "id")
             .groupBy("ws", "lang", "a", "l", "r", "score")
             .agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelt"))
             .withColumn("phrase", F.concat_ws(" ", F.col("spelt.word"))))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return (spelt.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
