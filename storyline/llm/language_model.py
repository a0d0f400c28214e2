"""A word bigram model with interpolated modified Kneser-Ney smoothing.

Spark counts; the model is files of sorted arrays in the shared folder, and
workers map them into memory to score.

*Vocabulary.*  Word hashes are dealt by their high bits over shards and sorted; a
word's number is its place in that order.  Beside each hash stand its count, the
number of different words before it, the count of it as a context and how many of
its followers were seen once, twice and more often.

*Bigrams.*  A bigram's key is the exact pair of word numbers.  Keys are dealt by
their first word; words with more than a shard's share of all tokens are dealt by
both, so no shard grows with one word.  Each task counts what it reads before
anything is shuffled, and sends sorted keys as packed differences.

Texts are lower-cased (A-Z) words and one end token, which is also the context of
the first word.  Null is the empty text.  Unknown words share the probability
that the lowest order keeps for one more word than the vocabulary has.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, scratch_path
from . import store
from .rows import shuffle_width
from .words import bytes_of, mix, ranges, slices, split_words, u64

END = u64(0xE0D0E0D0E0D0E0D1)
_FLUSH = 1 << 22  # entries a task holds before it sends them
_BIG = 255  # counts from here on stand in a list of their own


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and where each text's begin."""
    words = split_words(*bytes_of(texts), lower=True)
    hashes = words.hashes()
    hashes[hashes == END] ^= np.uint64(1)
    first = words.first + np.arange(len(words.first))
    out = np.full(len(hashes) + words.texts, END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = hashes
    return out, first


def _contexts(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The token before each; before the first, the end token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = end
    return before


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[head], np.diff(np.concatenate([head, [len(values)]]))


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; small ones leave planes of zeros."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(wide.T).tobytes(), "zstd", asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _sorted_bytes(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def _from_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(data), dtype=np.uint64)


@dataclass(frozen=True)
class Plan:
    """Where the model lies and how it is dealt; small enough for any closure."""

    folder: str
    bits: int  # 2**bits vocabulary shards
    shards: int  # of bigrams
    base: tuple[int, ...]  # first word number of each vocabulary shard, and their total
    total: int  # training tokens
    hot: tuple[int, ...]  # words dealt by the whole bigram, at most four for each shard

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"


class Vocabulary:
    def __init__(self, plan: Plan):
        self.plan = plan
        n = 1 << plan.bits
        self.hashes = [store.mapped(plan.path(f"hash-{s}"), np.uint64) for s in range(n)]
        self.ends = np.array([0, *plan.base[1:]])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(64 - self.plan.bits)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(len(self.hashes) + 1))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            own = self.hashes[s]
            if a < b and len(own):
                at = np.minimum(np.searchsorted(own, hashes[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == hashes[a:b], at + self.plan.base[s], -1)
        return out

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        unique, which = np.unique(hashes, return_inverse=True)
        return self.number(unique)[which]


def _shard(first: np.ndarray, second: np.ndarray, plan: Plan) -> np.ndarray:
    by = np.where(np.isin(first, plan.hot), first ^ second << 20, first)
    return (mix(by.astype(np.uint64)) % np.uint64(plan.shards)).astype(np.int64)


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in slices(batches, "__text"):
        held.append(_counted(tokens(batch.column("__text"))[0]))
        size += len(held[-1][0])
        if size > _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _vocabulary_files(folder: str, bits: int, share: int):
    """Write each shard's hashes and counts; return its size and the words with 1/share of its tokens."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        words, counts = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        shard = (words >> np.uint64(64 - bits)).astype(np.int64)
        for s in np.unique(shard):
            own = shard == s
            store.put(f"{folder}/hash-{s}", words[own].tobytes())
            store.put(f"{folder}/count-{s}", counts[own].astype(np.int64).tobytes())
            total = int(counts[own].sum())
            often = np.flatnonzero(counts[own] * share >= total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([int(own.sum())]), pa.array([total]),
                 pa.array([often.tolist()], pa.list_(pa.int64())), pa.array([counts[own][often].tolist()], pa.list_(pa.int64()))],
                names=["shard", "words", "tokens", "often", "times"])
    return write


def _bigrams(plan: Plan):
    """(shard, keys, counts): the bigrams of a task, counted and packed."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(plan)
        end = int(vocabulary.number(np.array([END]))[0])
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            shard = _shard((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), plan)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(plan.shards + 1))
            rows = [(s, _sorted_bytes(keys[order[a:b]]), _squeezed(counts[order[a:b]]))
                    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
            shards, packed, numbers = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(packed, pa.binary()),
                                               pa.array(numbers, pa.binary())], names=["shard", "keys", "counts"])

        for batch in slices(batches, "__text"):
            hashes, first = tokens(batch.column("__text"))
            ids = vocabulary.numbers_of(hashes)
            held.append(_counted(_key(_contexts(ids, first, end), ids)))
            size += len(held[-1][0])
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return emit


def _bigram_files(plan: Plan):
    """Write each shard's sorted keys and counts; return what its bigrams say about words, by vocabulary shard."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for s, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("shard", "keys", "counts")]):
                held.setdefault(s, []).append((_from_sorted(keys), _unsqueezed(counts).astype(np.int64)))
                if sum(len(k) for k, _ in held[s][1:]) > len(held[s][0][0]):  # merge when the rest has caught up
                    held[s] = [_summed(np.concatenate([k for k, _ in held[s]]), np.concatenate([c for _, c in held[s]]))]
        seen = np.zeros(4, np.int64)
        contexts, followers = [], []
        for s in sorted(held):
            keys, counts = _summed(np.concatenate([k for k, _ in held[s]]), np.concatenate([c for _, c in held.pop(s)]))
            big = counts >= _BIG
            store.put(plan.path(f"keys-{s}"), keys.tobytes())
            store.put(plan.path(f"counts-{s}"), np.minimum(counts, _BIG).astype(np.uint8).tobytes())
            store.put(plan.path(f"big-{s}"), np.stack([keys[big].astype(np.int64), counts[big]], 1).tobytes())
            words, at = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
            contexts.append((words, np.stack([np.add.reduceat(v.astype(np.int64), at) for v in
                                              (counts, counts == 1, counts == 2, counts > 2)], 1)))
            followers.append(_counted((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            seen += [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        if not contexts:
            return
        # a task says about a word once what all its shards have
        rows = []
        for kind, parts in ((0, contexts), (1, followers)):
            who, what = _summed(np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
            edges = np.searchsorted(who, plan.base)
            rows += [(v, kind, _sorted_bytes(who[a:b].astype(np.uint64)), _squeezed(what[a:b].reshape(-1)))
                     for v, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        v, kind, who, what = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64()), pa.array(kind, pa.int64()), pa.array(who, pa.binary()), pa.array(what, pa.binary()),
             *[pa.array([int(n)] + [0] * (len(rows) - 1), pa.int64()) for n in seen]],
            names=["shard", "kind", "words", "numbers", "n1", "n2", "n3", "n4"])
    return write


def _word_files(plan: Plan):
    """Add up what all shards say about the words of a vocabulary shard."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for v, kind, words, numbers in zip(*[batch.column(c).to_pylist()
                                                 for c in ("shard", "kind", "words", "numbers")]):
                size = plan.base[v + 1] - plan.base[v]
                context, before = held.setdefault(v, (np.zeros((size, 4), np.int64), np.zeros(size, np.int64)))
                at = (_from_sorted(words).astype(np.int64)) - plan.base[v]
                if kind:
                    before[at] += _unsqueezed(numbers).astype(np.int64)
                else:
                    context[at] += _unsqueezed(numbers).astype(np.int64).reshape(-1, 4)
        for v, (context, before) in sorted(held.items()):
            store.put(plan.path(f"context-{v}"), context.tobytes())
            store.put(plan.path(f"before-{v}"), before.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(before.sum())]), *[pa.array([int((before == i).sum())]) for i in (1, 2, 3, 4)],
                 pa.array([int((before > 2).sum())])], names=["total", "n1", "n2", "n3", "n4", "more"])
    return write


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many counts are 1, 2, 3 and 4."""
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(float(min(max(d, 0.0), i + 1 - 1e-3)) for i, d in enumerate(raw))


def train(docs: DataFrame, text: str = "text") -> str:
    """Count all rows and write the model; returns its folder in the shared folder."""
    spark = docs.sparkSession
    folder, width = scratch_path(spark, "bigram-model"), shuffle_width(spark)
    work = docs.select(F.coalesce(text, F.lit("")).alias("__text"))
    bits, n_shards = max(3, (width - 1).bit_length() - 2), 4 * width
    words = work.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    dealt = words.withColumn("__v", F.shiftrightunsigned("word", 64 - bits))
    # the writer needs a shard whole: its size is the vocabulary's, divided by a number that follows the cluster's
    shards = cut_lineage(dealt.repartition(width, "__v").select("word", "n").mapInArrow(
        _vocabulary_files(folder, bits, 4 * n_shards),
        "shard long, words long, tokens long, often array<bigint>, times array<bigint>"))
    sizes = {r.shard: r for r in shards.collect()}  # one row per shard
    for s in range(1 << bits):
        if s not in sizes:
            store.put(f"{folder}/hash-{s}", b"")
            store.put(f"{folder}/count-{s}", b"")
    base = np.concatenate([[0], np.cumsum([sizes[s].words if s in sizes else 0 for s in range(1 << bits)])])
    total = sum(r.tokens for r in sizes.values())
    # whoever has its share of all tokens has it of its shard's
    hot = tuple(int(base[s]) + w for s, r in sorted(sizes.items()) for w, n in zip(r.often, r.times)
                if n * 4 * n_shards >= total)
    plan = Plan(folder, bits, n_shards, tuple(int(b) for b in base), int(total), hot)
    about = cut_lineage(
        work.mapInArrow(_bigrams(plan), "shard long, keys binary, counts binary").repartition(width, "shard")
        .mapInArrow(_bigram_files(plan),
                    "shard long, kind long, words binary, numbers binary, n1 long, n2 long, n3 long, n4 long"))
    seen = about.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4")]).first()
    lower = cut_lineage(about.select("shard", "kind", "words", "numbers").repartition(width, "shard").mapInArrow(
        _word_files(plan), "total long, n1 long, n2 long, n3 long, n4 long, more long"))
    low = lower.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "n1", "n2", "n3", "n4", "more")]).first()
    store.put(plan.path("model.json"), json.dumps({
        "bits": bits, "shards": n_shards, "base": plan.base, "total": plan.total, "hot": plan.hot,
        "upper": discounts(*seen), "lower": discounts(*low[1:5]),
        "bigram_types": int(low[0]), "before": [int(low[1]), int(low[2]), int(low[5])]}).encode())
    return folder


class Model:
    """Maps a model's files and gives probabilities."""

    def __init__(self, folder: str):
        about = json.loads(store.get(f"{folder}/model.json"))
        self.plan = Plan(folder, about["bits"], about["shards"], tuple(about["base"]), about["total"], tuple(about["hot"]))
        self.words = self.plan.base[-1]
        self.vocabulary = Vocabulary(self.plan)
        self.upper, self.lower = (np.array([0.0, *about[k]]) for k in ("upper", "lower"))
        self.types, seen = about["bigram_types"], np.array(about["before"], float)
        self.spare = float((self.lower[1:] * seen).sum() / self.types) if self.types else 1.0
        n = 1 << self.plan.bits
        filled = [self.plan.base[v + 1] > self.plan.base[v] for v in range(n)]
        self.count = [store.mapped(self.plan.path(f"count-{v}"), np.int64) for v in range(n)]
        self.context = [store.mapped(self.plan.path(f"context-{v}"), np.int64).reshape(-1, 4) if filled[v] else None
                        for v in range(n)]
        self.before = [store.mapped(self.plan.path(f"before-{v}"), np.int64) if filled[v] else None for v in range(n)]
        self.opened: dict[int, tuple] = {}
        end = self.vocabulary.number(np.array([END]))
        self.end = int(end[0])

    def _gather(self, arrays: list, numbers: np.ndarray, width: int | None = None) -> np.ndarray:
        """Entries of sorted word numbers; zero for unknown ones."""
        out = np.zeros(len(numbers) if width is None else (len(numbers), width), np.int64)
        edges = np.searchsorted(numbers, self.plan.base)
        for v, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                out[a:b] = arrays[v][numbers[a:b] - self.plan.base[v]]
        return out

    def _bigram_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        shard, keys = _shard(first, second, self.plan), _key(first, second)
        order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
        edges = np.searchsorted(shard[order], np.arange(self.plan.shards + 1))
        out = np.zeros(len(keys), np.int64)
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            if s not in self.opened:
                try:
                    big = np.frombuffer(store.get(self.plan.path(f"big-{s}")), np.int64).reshape(-1, 2)
                    self.opened[s] = (store.mapped(self.plan.path(f"keys-{s}"), np.uint64),
                                      store.mapped(self.plan.path(f"counts-{s}"), np.uint8),
                                      {int(k): int(c) for k, c in big})
                except FileNotFoundError:  # a shard that got no bigram has no file
                    self.opened[s] = (np.zeros(0, np.uint64), np.zeros(0, np.uint8), {})
            own, counts, big = self.opened[s]
            if not len(own):
                continue
            wanted = keys[order[a:b]]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            got = np.where(own[at] == wanted, counts[at], 0).astype(np.int64)
            for i in np.flatnonzero(got == _BIG):
                got[i] = big[int(wanted[i])]
            out[order[a:b]] = got
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, the unigram base score and the model's score (log10)."""
        hashes, first = tokens(texts)
        unique, which = np.unique(hashes, return_inverse=True)
        numbers = self.vocabulary.number(unique)
        # words by number: the unknown (-1) come first
        order = np.argsort(numbers, kind="stable")
        ranked = numbers[order]
        known = np.flatnonzero(ranked >= 0)
        count, before = np.zeros(len(ranked), np.int64), np.zeros(len(ranked), np.int64)
        context = np.zeros((len(ranked), 4), np.int64)
        count[known] = self._gather(self.count, ranked[known])
        before[known] = self._gather(self.before, ranked[known])
        context[known] = self._gather(self.context, ranked[known], 4)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[which]
        base = np.log10((count + 1) / (self.plan.total + self.words + 1))
        low = np.maximum(before - self.lower[np.minimum(before, 3)], 0) / max(1, self.types) + self.spare / (self.words + 1)
        total = context[:, 0]
        gamma = np.where(total > 0, context[:, 1:] @ self.upper[1:] / np.maximum(total, 1), 1.0)
        # each different pair once; the context before the first token is the end token
        ends = place[np.searchsorted(unique, END)]
        left = _contexts(at, first, int(ends))
        pairs, where = np.unique(left * len(ranked) + at, return_inverse=True)
        a, b = pairs // len(ranked), pairs % len(ranked)
        both = (ranked[a] >= 0) & (ranked[b] >= 0)
        seen = np.zeros(len(pairs), np.int64)
        seen[both] = self._bigram_counts(ranked[a[both]], ranked[b[both]])
        high = np.where(total[a] > 0, np.maximum(seen - self.upper[np.minimum(seen, 3)], 0) / np.maximum(total[a], 1), 0.0)
        log = np.log10(high + gamma[a] * low[b])
        start = first[:-1]
        return {"n_tokens": np.diff(first), "n_known": np.add.reduceat((count > 0)[at].astype(np.int64), start),
                "base_score": np.add.reduceat(base[at], start), "score": np.add.reduceat(log[where], start)}


def score_texts(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    work = docs.select(key, F.coalesce(text, F.lit("")).alias("__text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches, "__text"):
            model = model or Model(folder)
            got = model.score(batch.column("__text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(got["n_tokens"]), pa.array(got["n_known"]),
                 pa.array(np.full(len(batch), model.plan.total, np.int64)), pa.array(got["base_score"]),
                 pa.array(got["score"])],
                names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)[key]
    return work.mapInArrow(
        emit, f"{key} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
