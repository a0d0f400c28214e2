"""Toxicity of texts from a learned lexicon, its misspellings and their context.

Terms are learned from labelled documents: words, and stems (word beginnings)
that many inflected words share, whose document frequency is far higher in toxic
than in clean documents.  A word within edit distance 1 of a term counts as its
misspelling; it is found by walking the trie of all terms and the word's
Levenshtein automaton together.  Words that clean training documents use are not
misspellings.  A hit between quotation marks counts apart from a plain one, and a
logistic model weighs plain, misspelled and quoted hits.

Words are split at blanks and ASCII punctuation, A-Z in lower case, over bytes.
Null counts as the empty text, which has the score of a text without hits.
Without labelled rows of both classes the score is the share of toxic ones (0
where there are none).
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .words import IN_TERM, bytes_of, join_hashes, slices, split_words, windows

# Rows of labels that the model is fitted on at most.
MAX_LABELLED = 10_000
_STEM = range(3, 9)
_MIN_DOCS, _MIN_LOG_ODDS = 8, 3.0
_FUZZY_FROM = 5  # bytes a term needs before misspellings count
_CONTEXT = 3  # words looked at on each side of a hit
_QUOTES = (b'"', "“".encode(), "”".encode(), "„".encode(), "«".encode(), "»".encode())


@dataclass
class Toxicity:
    """``terms`` maps a term to whether it is a stem."""

    terms: dict[bytes, bool] = field(default_factory=dict)
    clean: frozenset[bytes] = frozenset()
    weights: tuple[float, ...] = ()
    prior: float = 0.0


class Trie:
    """Terms as nested dictionaries; ``None`` marks an end and holds whether it is a stem."""

    def __init__(self, terms: dict[bytes, bool]):
        self.root: dict = {}
        for term, stem in terms.items():
            node = self.root
            for byte in term:
                node = node.setdefault(byte, {})
            node[None] = stem

    def near(self, word: bytes, errors: int = 1) -> bool:
        """Is a term within ``errors`` edits of the word, or of a beginning of it if a stem?

        A state of the word's automaton is the row of edit distances between all
        its beginnings and the path walked; a branch of the trie ends where the
        row has no value within the limit.
        """
        def walk(node: dict, row: list[int]) -> bool:
            stem = node.get(None)
            if stem is not None and (row[-1] <= errors or (stem and min(row) <= errors)):
                return True
            for byte, child in node.items():
                if byte is None:
                    continue
                step = [row[0] + 1]
                for i, own in enumerate(word):
                    step.append(min(step[i] + 1, row[i + 1] + 1, row[i] + (own != byte)))
                if min(step) <= errors and walk(child, step):
                    return True
            return False
        return walk(self.root, list(range(len(word) + 1)))


class _Finder:
    """Marks words of a batch: 0 no hit, 1 a term, 2 a misspelling."""

    def __init__(self, model: Toxicity):
        self.model = model
        self.whole = {t for t, stem in model.terms.items() if not stem}
        self.stems = {t for t, stem in model.terms.items() if stem}
        self.stem_lengths = sorted({len(t) for t in self.stems})
        fuzzy = {t: s for t, s in model.terms.items() if len(t) >= _FUZZY_FROM}
        self.trie = Trie(fuzzy)
        # one of the two halves of a term survives a single edit
        parts = {(0, term) for term in model.terms if len(term) < _FUZZY_FROM}
        for term in fuzzy:
            cut = len(term) // 2
            parts.add((0, term[:cut][:8]))
            parts.update((cut + shift, term[cut:][:8]) for shift in (-1, 0, 1))
        # by offset: which first two bytes occur, and the sorted parts of each length
        self.parts: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
        for offset in sorted({o for o, _ in parts}):
            own = [p for o, p in parts if o == offset]
            leads = np.zeros(1 << 16, bool)
            for part in own:
                if len(part) > 1:
                    leads[int.from_bytes(part[:2], "little")] = True
                else:
                    leads[part[0]::256] = True
            self.parts[offset] = leads, {
                n: np.unique(np.array([int.from_bytes(p, "little") for p in own if len(p) == n], np.uint64))
                for n in sorted({len(p) for p in own})}
        self.memo: dict[bytes, int] = {}

    def _kind(self, word: bytes) -> int:
        if word in self.whole or any(word[:n] in self.stems for n in self.stem_lengths):
            return 1
        if len(word) < _FUZZY_FROM - 1 or word in self.model.clean:
            return 0
        return 2 if self.trie.near(word) else 0

    def kind(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[word] = self._kind(word)
        return found

    def mark(self, words) -> np.ndarray:
        """Only words that share half a term, or a term's first bytes, are looked at one by one."""
        out = np.zeros(len(words.start), np.int8)
        if not self.model.terms or not len(out):
            return out
        padded = np.concatenate([words.data, np.zeros(24, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        maybe = np.zeros(len(out), bool)
        first = eight[words.start]
        for offset, (leads, by_length) in self.parts.items():
            at = first if not offset else eight[np.minimum(words.start + offset, len(eight) - 1)]
            led = np.flatnonzero(leads[(at & np.uint64(0xFFFF)).astype(np.int64)] & ~maybe)
            for n, own in by_length.items():
                value = at[led] & np.uint64((1 << (8 * n)) - 1)
                maybe[led] |= own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value
        for i in np.flatnonzero(maybe):
            out[i] = self.kind(words.data[words.start[i]:words.end[i]].tobytes())
        return out


def _quoted(words, i: int) -> bool:
    """Does the context have a quotation mark on both sides of word ``i``?"""
    text = int(np.searchsorted(words.first, i, "right")) - 1
    a = max(words.first[text], i - _CONTEXT)
    b = min(words.first[text + 1], i + _CONTEXT + 1) - 1
    left = words.data[words.start[a] - (1 if words.start[a] > words.offsets[text] else 0):words.start[i]].tobytes()
    right = words.data[words.end[i]:words.end[b] + (1 if words.end[b] < words.offsets[text + 1] else 0)].tobytes()
    return any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES)


def _features(counts: np.ndarray) -> np.ndarray:
    plain, misspelled, quoted = counts.astype(float).T
    return np.column_stack([np.ones(len(plain)), np.log1p(plain), np.log1p(misspelled), np.log1p(quoted),
                            plain + misspelled >= 2])


def _counts(words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain, misspelled and quoted hits per text, and the words that are hits."""
    hits = np.flatnonzero(marks)
    texts = np.searchsorted(words.first, hits, "right") - 1
    quoted = np.fromiter((_quoted(words, i) for i in hits), bool, len(hits))
    column = np.where(quoted, 2, marks[hits] - 1)
    counts = np.zeros((words.texts, 3), np.int64)
    np.add.at(counts, (texts, column), 1)
    return counts, hits


def _labelled(docs: DataFrame, labels: DataFrame, eligible: Column | None, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows (text, toxic): those whose id hashes lowest."""
    chosen = labels.filter("doc_id is not null and toxic is not null")
    if eligible is not None:
        chosen = chosen.filter(eligible)
    chosen = (chosen.groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    # bounded by the limit, so the texts need no shuffle
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
            .join(F.broadcast(chosen), "doc_id").select("__text", "__toxic"))


def _sketched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's five-word shingles; near copies mostly agree in it."""
    for batch in slices(rows, "__text", 2 << 20):
        words = split_words(*bytes_of(batch.column("__text")), lower=True, inside=IN_TERM)
        hashes = words.hashes()
        shingles, whole = join_hashes(hashes, 5), windows(words, 5)
        sketch = np.zeros(words.texts, np.uint64)
        for t in range(words.texts):
            own = slice(words.first[t], words.first[t + 1])
            values = shingles[own][whole[own]]
            values = values if len(values) else hashes[own]
            sketch[t] = values.min() if len(values) else 0
        yield pa.RecordBatch.from_arrays([batch.column("__text"), batch.column("__toxic").cast(pa.int32()),
                                          pa.array(sketch.view(np.int64))], names=["__text", "__toxic", "__sketch"])


def _document_frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows, "__text", 2 << 20):
        words = split_words(*bytes_of(batch.column("__text")), lower=True, inside=IN_TERM)
        toxic = batch.column("__toxic").to_numpy(zero_copy_only=False)
        found: dict[bytes, list[int]] = {}
        for t in range(words.texts):
            text = words.data[words.offsets[t]:words.offsets[t + 1]].tobytes()
            marked = any(q in text for q in _QUOTES)  # what is only quoted says nothing about the text
            own = {words.data[words.start[i]:words.end[i]].tobytes()
                   for i in range(words.first[t], words.first[t + 1]) if not (marked and _quoted(words, i))}
            stems = set()
            for word in own:
                # stems are cut between characters only
                chars = word.decode(errors="ignore")
                stems.update(chars[:k].encode() for k in _STEM if k <= len(chars))
            bad = bool(toxic[t])
            for term in stems | own:
                entry = found.setdefault(term, [0, 0, 0])
                entry[0 if bad else 1] += 1
                entry[2] += bad and term in own
        columns = list(zip(*found.values())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), *[pa.array(c, pa.int64()) for c in columns]],
            names=["term", "toxic", "clean", "whole"])


def _choose(rows: Iterable, n_toxic: int, n_clean: int) -> dict[bytes, bool]:
    """Of the candidates (term, toxic, clean, whole) those not said by a shorter one.

    A stem is lengthened while nine tenths of its documents stay, so a family of
    beginnings of one word becomes that word.
    """
    stats = {bytes(r[0]): (r[1], r[3]) for r in rows}
    following: dict[bytes, list[bytes]] = {}
    for term in stats:
        chars = term.decode(errors="ignore")
        following.setdefault(chars[:-1].encode(), []).append(term)
    chosen: dict[bytes, bool] = {}
    beginnings: set[bytes] = set()
    for term in sorted(stats, key=lambda t: (len(t), t)):
        if any(term[:k] in chosen for k in range(1, len(term) + 1)):
            continue
        if term in beginnings:
            continue
        grown = term
        while longer := [t for t in following.get(grown, []) if stats[t][0] >= 0.9 * stats[term][0]]:
            grown = max(longer, key=lambda t: stats[t][0])
        chosen[grown] = stats[grown][1] < 0.9 * stats[grown][0]
        beginnings.update(grown[:k] for k in range(1, len(grown)))
    return chosen


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps; a small penalty keeps separable data finite."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1e-2)
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn_toxicity(docs: DataFrame, labels: DataFrame, eligible: Column | None = None,
                   max_labelled: int = MAX_LABELLED) -> Toxicity:
    """Learn terms and weights from at most ``max_labelled`` labelled documents.

    ``eligible`` is a condition on ``labels`` rows.  Every term that passes the test
    of count and odds is learned.  What reaches the driver is bounded by the limit:
    a term takes ``_MIN_DOCS`` of the documents at least.
    """
    rows = _labelled(docs, labels, eligible, max_labelled)
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("__toxic"), F.lit(0)).alias("t")).first()
    n_toxic, n_clean = int(sizes.t), int(sizes.n) - int(sizes.t)
    if not n_toxic or not n_clean:
        return Toxicity(prior=float(n_toxic > 0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # near copies of one text are one witness, or all their words would be terms
    candidates = (rows.mapInArrow(_sketched, "__text string, __toxic int, __sketch long").dropDuplicates(["__sketch"])
                  .mapInArrow(_document_frequencies, "term binary, toxic long, clean long, whole long")
                  .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                       F.sum("whole").alias("whole"))
                  .filter((F.col("toxic") >= _MIN_DOCS) & (odds >= _MIN_LOG_ODDS)).collect())
    model = Toxicity(_choose([tuple(r) for r in candidates], n_toxic, n_clean), prior=n_toxic / (n_toxic + n_clean))
    seen = rows.mapInArrow(_hits_of(model), "toxic int, plain long, quoted long, misspelled array<binary>").collect()
    seen.sort(key=lambda r: (sorted(map(bytes, r.misspelled)), r.toxic, r.plain, r.quoted))
    # each half is counted with the clean words of the other, or no clean document would have a misspelling
    used: list[set[bytes]] = [set(), set()]
    for i, r in enumerate(seen):
        if not r.toxic:
            used[i % 2].update(map(bytes, r.misspelled))
    counts = np.array([[r.plain, sum(bytes(w) not in used[1 - i % 2] for w in r.misspelled), r.quoted]
                       for i, r in enumerate(seen)])
    clean = frozenset(used[0] | used[1])
    weights = _fit(_features(counts), np.array([float(r.toxic) for r in seen]))
    return Toxicity(model.terms, clean, weights, model.prior)


def _hits_of(model: Toxicity):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(model)
        for batch in slices(batches, "__text"):
            words = split_words(*bytes_of(batch.column("__text")), lower=True, inside=IN_TERM)
            marks = finder.mark(words)
            counts, at = _counts(words, marks)
            lists: list[list[bytes]] = [[] for _ in range(words.texts)]
            for i in at[marks[at] == 2]:
                lists[int(np.searchsorted(words.first, i, "right")) - 1].append(
                    words.data[words.start[i]:words.end[i]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__toxic").cast(pa.int32()), pa.array(counts[:, 0]), pa.array(counts[:, 2]),
                 pa.array(lists, pa.list_(pa.binary()))], names=["toxic", "plain", "quoted", "misspelled"])
    return hits


def with_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows and columns, and the score (0 to 1) as ``out``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, weights = _Finder(model), np.array(model.weights)
        for batch in slices(batches, text):
            words = split_words(*bytes_of(batch.column(text)), lower=True, inside=IN_TERM)
            if len(weights):
                x = _features(_counts(words, finder.mark(words))[0])
                values = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            else:
                values = np.full(words.texts, model.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, out])

    return docs.mapInArrow(score, schema)
