"""Every operator against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from storyline.llm import jaccard, packing, quality, toxicity
from storyline.llm.decontamination import RADIUS, blocks, find_leaks, without_leaks
from storyline.llm.fingerprints import edited_fingerprints
from storyline.llm.language_model import discounts, score_texts, train
from storyline.llm.rows import components
from storyline.llm.suffixes import multikey_order, remove_repeated_bytes
from storyline.llm.superkmers import remove_repeated_words
from storyline.llm.token_ids import Encoder, check_sums, read_token_files, token_folder, write_token_files
from storyline.llm.wavelet import WaveletMatrix, encode
from storyline.llm.words import bytes_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, score string, __n int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    syllables = ["re", "the", "on", "é", "ing", "au", "st", "und", "ß", "lo"]

    def text(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    passage = text(90)
    rows = [(None, "no id " + text(60)), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two three"), (5, "One TWO three")]
    base = text(200)
    for i in range(12):      # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((20 + i, " ".join(w)))
    rows += [(40 + i, text(30) + " " + passage + " " + text(40)) for i in range(8)]
    rows += [(60 + i, base) for i in range(9)]      # exact copies
    rows += [(80, text(6000)), (81, "same " * 700), (82, "x" * 3000), (83, "ab" * 900 + "c"), (84, "é" * 700)]
    rows += [(90, "repeated row " + text(100))] * 2 + [(91, "another text"), (91, "under one id " + text(50))]
    rows += [(100 + i, text(rng.randint(1, 120))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, "y", 2) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- fingerprints ----------------------------------------------------------

def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def cased(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(docs, corpus, empty):
    got = collections.defaultdict(list)
    for r in edited_fingerprints(docs).collect():
        got[r.doc_id].append(r)
    order = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in corpus), key=lambda r: (-r[0], r[1]))
    errors, seen = [], {}
    for at, (_, text, i) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in got[i] if r.n_chars == len(text) and r.edited_sha256 == sha)
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = cased(text), cased(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert sum(map(len, got.values())) == len(corpus)
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.02
    assert edited_fingerprints(empty).collect() == []


def test_fingerprints_use_no_python(docs, plan_of):
    plan = plan_of(edited_fingerprints(docs))
    assert not re.search("Python|Pandas|Arrow", plan) and "SinglePartition" not in plan


# ---- Jaccard join ----------------------------------------------------------

def classes_by_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def test_jaccard_classes(docs, corpus, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == classes_by_force(corpus)
    assert jaccard.jaccard_classes(empty).collect() == []


@pytest.mark.parametrize("small, hot", [(1, 1 << 20), (4, 1), (1000, 1)])
def test_jaccard_does_not_depend_on_group_limits(docs, corpus, monkeypatch, small, hot):
    monkeypatch.setattr(jaccard, "_SMALL", small)
    monkeypatch.setattr(jaccard, "_HOT", hot)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == classes_by_force(corpus)


def test_rows_without_key_link_their_copies(spark):
    rng = random.Random(17)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    near = [*base[:60], "edit", *base[61:]]
    rows = [(None, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)), (None, " ".join(near)), (9, "of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == classes_by_force(rows) and [c for _, _, c in got].count(7) == 4
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(docs).collect()) == [7, 9]


def test_a_chain_of_near_copies_and_a_passage_of_many(spark):
    rng = random.Random(23)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    # each text replaces two words of the one before: neighbours link, ends do not
    chain, rows = fresh(150), []
    for i in range(300):
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"edit{i}-{rng.random()}"
        rows.append((i, " ".join(chain)))
    passage = fresh(60)
    rows += [(1000 + i, " ".join([*fresh(rng.randint(10, 80)), *passage, *fresh(rng.randint(10, 80))])) for i in range(300)]
    star = fresh(140)    # copies of one text, two words changed in each
    for i in range(300):
        copy = list(star)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = f"own{i}-{rng.random()}"
        rows.append((2000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == classes_by_force(rows)
    ends = shingles(rows[0][1]), shingles(rows[299][1])
    assert 100 * len(ends[0] & ends[1]) < 80 * len(ends[0] | ends[1])


def test_a_shared_passage_comes_last_however_texts_are_dealt(spark):
    rng = random.Random(41)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*(f"v{rng.randrange(10**9)}" for _ in range(200)), *passage])) for i in range(60)]
    work = spark.createDataFrame(rows, "__rid long, __text string").repartition(20).selectExpr(
        "__rid", "__rid as __key", "__text")
    hot = jaccard._hot_shingles(jaccard._describe(work, 5))
    tokens = jaccard._tokens(work, "__text", 5, 80, hot)
    assert tokens.groupBy("shingle").count().agg({"count": "max"}).first()[0] == 1


def test_pairs_to_check_grow_with_the_members_of_a_group(spark, monkeypatch):
    rng = random.Random(31)
    star, rows = [f"v{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(400):    # linked with the middle or with none; most pairs of two have a similarity of 0.5 to 0.8
        copy = list(star)
        for at in rng.sample(range(len(copy)), rng.randint(0, 5)):
            copy[at] = f"own{i}-{at}"
        rows.append((i, " ".join(copy)))
    checked, verified = [], jaccard._verified

    def counted(steps, work, nodes, pairs, *rest):
        checked.append(pairs.count())
        return verified(steps, work, nodes, pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == classes_by_force(rows) and len({c for _, _, c in got}) > 20
    assert sum(checked) <= 4 * len(rows)


@pytest.mark.parametrize("sizes", [(1, 40), (15, 17), (300, 3000), (2049, 2049)])
def test_signatures_bound_the_overlap_from_above(sizes):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in rng.integers(sizes[0], sizes[1] + 1, 40)]
    table = pa.table({"s": pa.array([jaccard._signature(x) for x in sets], pa.binary())})
    size = np.array([len(x) for x in sets])
    i, j = np.divmod(np.arange(40 * 40), 40)
    most = jaccard._overlaps(table, ("s", "s"), i, j, (size, size))
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (most >= true).all() and (most[i == j] == size).all()


def test_one_of_each_stays(docs, corpus):
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_one_of_each(docs).collect())
    groups = collections.defaultdict(set)
    for i, n, component in classes_by_force(corpus):
        if n:
            groups[component].add(i)
    assert kept[20, dict(corpus)[20]] == 1 and not any(20 < (i or 0) < 32 or 60 <= (i or 0) < 69 for i, _ in kept)
    assert kept[90, dict(corpus)[90]] == 1      # a repeated row once
    assert sum(i == 91 for i, _ in kept) == 2   # two texts under one id are two documents
    assert all((i, t) in kept for i, t in corpus if not words(t))
    assert len({i for i, _ in kept}) >= len(groups)


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500), (7, 7)]
    rng.shuffle(links)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1500: 1000, 2000: 1000}


# ---- repeated bytes and words ----------------------------------------------

def test_repeated_bytes(docs, corpus, empty):
    for length in (64, 400):
        count = collections.Counter(b[i:i + length] for _, t in corpus for b in [(t or "").encode()]
                                    for i in range(len(b) - length + 1))
        want = collections.Counter()
        for i, t in corpus:
            b = (t or "").encode()
            gone = np.zeros(len(b) + 1, bool)
            for at in range(len(b) - length + 1):
                if count[b[at:at + length]] > 1:
                    gone[at:at + length] = True
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want[i, len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone) if not g)] += 1
        rows = remove_repeated_bytes(docs, length=length).collect()
        assert collections.Counter((r.doc_id, r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"]))
                                   for r in rows) == want
        assert rows[0].node == "x" and rows[0].bucket == 1
    assert remove_repeated_bytes(empty).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 24)).astype(np.uint8)
    rows[:200, :16] = 1
    got = [rows[i].tobytes() for i in multikey_order(rows)]
    assert got == sorted(r.tobytes() for r in rows)


def test_repeated_words(docs, corpus, empty):
    first = {}
    for i, t in sorted(corpus, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        w = words(t)
        for at in range(len(w) - 12):
            first.setdefault(tuple(w[at:at + 13]), i)
    want = collections.Counter()
    for i, t in corpus:
        w = words(t)
        gone = [False] * len(w)
        for at in range(len(w) - 12):
            if first[tuple(w[at:at + 13])] != i:
                gone[at:at + 13] = [True] * 13
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    rows = remove_repeated_words(docs).collect()
    assert collections.Counter((r.doc_id, r["__n_words"], r["__n_removed"], r["__kept"]) for r in rows) == want
    assert remove_repeated_words(empty).collect() == []


def test_texts_without_repeats_pass_one_worker(docs, plan_of):
    # two for the texts that may be cut, as they are moved between; one for the others
    for cut in (remove_repeated_words(docs), remove_repeated_bytes(docs)):
        assert plan_of(cut).count("MapInArrow") == 3


# ---- token ids -------------------------------------------------------------

def test_pieces_give_the_ids_of_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, rng = Encoder(path), random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", " ", "　", "\x1c", "\x85", "a", "the", "B", "é", ".", ",", "'s", "'",
             "%%%", "1", "12", "<|endoftext|>", "|", "́", "中", "\U0001f600", "\r\n", "\x00", "_"]
    for _ in range(3):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
        ids, count = encoder.encode(*bytes_of(pa.array(texts)))
        edge = np.concatenate([[0], np.cumsum(count)])
        for t, text in enumerate(texts):
            assert ids[edge[t]:edge[t + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_added_tokens_in_a_text_are_matched():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, fresh, rng = Encoder(path), Tokenizer.from_file(path), random.Random(18)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "the", ".", "'s", "1", "é", "|"]
    texts = ["x <|endoftext|> y", "<|endof", "text|>", "", *("".join(rng.choice(parts) for _ in range(rng.randrange(25)))
                                                         for _ in range(3000))]
    assert 50256 in fresh.encode(texts[0], add_special_tokens=False).ids
    ids, count = encoder.encode(*bytes_of(pa.array(texts)))
    edge = np.concatenate([[0], np.cumsum(count)])
    for t, text in enumerate(texts):
        assert ids[edge[t]:edge[t + 1]].tolist() == fresh.encode(text, add_special_tokens=False).ids, ascii(text)


def test_wide_ids_are_kept_or_refused():
    ids = np.array([70000, 5, 70000, 131071, 0], np.uint32)
    matrix = WaveletMatrix(encode(ids, [1, None], np.array([2, 3]), 17))
    assert [matrix.access(i) for i in range(5)] == ids.tolist()
    with pytest.raises(ValueError, match="131071 does not fit"):
        encode(ids, [1, None], np.array([2, 3]), 16)


def test_wavelet_matrix():
    for n in (0, 1, 65536, 150_001):
        ids = np.random.default_rng(n).integers(0, 50257, n) if n < 100_000 else np.arange(n) % 7 * 9000
        matrix = WaveletMatrix(encode(ids, [None, 5], np.array([0, n])))
        assert (matrix.decode() == ids).all() and matrix.keys == [None, 5]
        for i in {0, n // 2, n - 1} if n else ():
            assert matrix.access(i) == ids[i]
            where = np.flatnonzero(ids == ids[i])
            token = int(ids[i])
            assert matrix.count(token) == len(where)
            assert matrix.count(token, i) == int((ids[i:] == token).sum())
            assert [matrix.find(token, k) for k in (0, len(where) - 1)] == [where[0], where[-1]]
        if n:
            assert matrix.count(60_000) == 0
            with pytest.raises(IndexError):
                matrix.access(n)


def test_token_files(spark, docs, corpus, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Encoder(path).tokenizer
    files = write_token_files(docs, path, token_folder(spark), shard_tokens=500)
    assert files.count() >= 4
    at, want, bodies = 0, [], []
    for i, t in sorted(corpus, key=lambda r: (-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        bodies.append(ids.tobytes())
        at += len(ids)
    assert sorted(map(tuple, check_sums(files).collect()), key=lambda r: r[1]) == want
    assert [bytes(r.ids) for r in sorted(read_token_files(files).collect(), key=lambda r: r.start)] == bodies
    assert check_sums(write_token_files(empty, path, token_folder(spark))).collect() == []


# ---- language model --------------------------------------------------------

def test_language_model(spark, docs, corpus, empty):
    trained = [words(lower(t)) + [None] for i, t in corpus if (i or 0) % 3]
    count = collections.Counter(w for t in trained for w in t)
    pairs = collections.Counter(p for t in trained for p in zip([None, *t[:-1]], t))
    n, v = sum(count.values()), len(count)
    upper = (0, *discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))
    before = collections.Counter(b for _, b in pairs)
    low = (0, *discounts(*[sum(c == k for c in before.values()) for k in (1, 2, 3, 4)]))
    spare = sum(low[min(c, 3)] for c in before.values()) / len(pairs)

    def lower_p(w):
        return max(before[w] - low[min(before[w], 3)], 0) / len(pairs) + spare / (v + 1)

    total, kept = collections.Counter(), collections.Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        kept[a] += upper[min(c, 3)]

    def p(a, b):
        if not total[a]:
            return lower_p(b)
        return max(pairs[a, b] - upper[min(pairs[a, b], 3)], 0) / total[a] + kept[a] / total[a] * lower_p(b)

    for a in (None, "the", "nowhere"):      # a distribution over the vocabulary and one unknown word
        assert sum(p(a, w) for w in count) + p(a, "\x00") == pytest.approx(1.0)
    folder = train(docs.filter("coalesce(doc_id, 0) % 3 <> 0"))
    want = collections.Counter()
    for i, t in corpus:
        w = words(lower(t)) + [None]
        want[i, len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6),
             round(sum(math.log10(p(a, b)) for a, b in zip([None, *w[:-1]], w)), 6)] += 1
    rows = score_texts(docs, folder).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                               for r in rows) == want
    assert score_texts(empty, folder).collect() == []
    nothing = train(empty)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in score_texts(docs, nothing).collect())


# ---- quality, toxicity -----------------------------------------------------

def test_quality(spark, empty):
    rng = random.Random(3)
    syllables = ["re", "the", "on", "ing", "au", "st", "und", "lo"]

    def clean(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."

    rows = [(i, clean(rng.randint(20, 80)), "en" if i % 3 else None) for i in range(400)]
    rows += [(400 + i, "".join(rng.choice("%$#&*!|Q7") for _ in range(200)), "en") for i in range(20)]
    rows += [(420 + i, "st " * 100, "fr") for i in range(5)] + [(430, None, None), (431, "", "en"), (432, "ab", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.learn_quality(docs, spark.range(300).withColumnRenamed("id", "doc_id"))
    got = {r.doc_id: r["__keep"] for r in quality.classified(docs, model).collect()}
    assert len(got) == len(rows) and sum(got[i] for i in range(400)) >= 380
    assert not any(got[i] for i in range(400, 425)) and got[430] and got[431] and got[432]
    assert quality.classified(empty, model).collect() == []
    blank = quality.learn_quality(empty, spark.range(0).withColumnRenamed("id", "doc_id"))
    assert all(r["__keep"] for r in quality.classified(docs, blank).collect())


def test_quality_counts_all_trusted_rows(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(13_000)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").cache()
    model = quality.learn_quality(docs, docs.select(F.col("doc_id").cast("int")))
    counted = [r.text for r in docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == 0).select("text").collect()]
    assert spark.read.parquet(f"{model.tables}/p-4").count() == len({t[i:i + 4] for t in counted for i in range(3)})


def test_trie_finds_what_edit_distance_finds():
    rng = random.Random(4)
    terms = {b"moron": False, b"stupid": False, b"achlich": True}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    trie = toxicity.Trie(terms)
    for _ in range(3000):
        word = bytearray(rng.choice(list(terms)) + rng.choice([b"", b"s", b"keit"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word))
            word[at:at + rng.randint(0, 1)] = rng.choice([b"", b"x", b"o"])
        word = bytes(word)
        want = any(min(distance(t, word[:k]) for k in range(len(word) + 1)) <= 1 if stem else distance(t, word) <= 1
                   for t, stem in terms.items())
        assert trie.near(word) == want, word


def test_toxicity(spark, empty):
    rng = random.Random(6)
    filler = ["".join(rng.choice("aeioust") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(filler) for _ in range(rng.randint(20, 60))]
        kind = i % 6
        if kind in (0, 1):
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumblor", "snorvel", "zwick" + rng.choice(["en", "ung", "ich"])])
        if kind == 2:
            w[3:6] = ['said "', rng.choice(["grumblor", "snorvel"]), '" again']
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind in (0, 1))))
    rows += [(700, None), (701, ""), (702, "the grumblpr, a snorvell and snrvel"), (702, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, table, eligible=F.col("doc_id") % 5 != 0)
    assert {b"grumblor", b"snorvel"} <= set(model.terms) and model.terms[b"zwick"]
    got = collections.defaultdict(list)
    for r in toxicity.with_toxicity(docs, model).collect():
        got[r.doc_id].append(r.toxicity)
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum((got[i][0] >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert got[700] == got[701] and got[700][0] < 0.5 and len(got[702]) == 2
    assert toxicity.with_toxicity(empty, model).collect() == []
    for none in (table.filter("toxic = 0"), table.limit(0)):
        assert {r.toxicity for r in toxicity.with_toxicity(docs, toxicity.learn_toxicity(docs, none)).collect()} == {0.0}


def test_every_toxic_term_is_learned(spark):
    rng = random.Random(16)

    def name():
        return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(4))

    terms, filler = [name() for _ in range(90)], [name() for _ in range(300)]
    texts = [[rng.choice(filler) for _ in range(30)] for _ in range(2 * 12 * len(terms))]
    for i in range(12 * len(terms)):      # each term in 12 of 1,080 toxic documents, a share of 1.1 percent
        texts[i][15] = terms[i % len(terms)]
    rows = [(i, " ".join(w), int(i < 12 * len(terms))) for i, w in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity >= 0.5 for r in toxicity.with_toxicity(docs, model).collect()}
    assert all(any(t.startswith(m.decode()) for m in model.terms) for t in terms)      # itself or its stem
    assert all(got[i] for i, _, y in rows if y)


# ---- decontamination -------------------------------------------------------

def test_blocks_meet_within_the_radius():
    rng = random.Random(8)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), RADIUS):
            b ^= 1 << bit
        assert set(blocks(a)) & set(blocks(b))


def test_leaks(spark, docs, empty):
    rng = random.Random(9)
    items = [" ".join(f"q{rng.randrange(5000)}" for _ in range(n)) for n in (15, 25, 40, 56)]
    near = items[3].split()
    near[-1] = "changed"
    far = items[2].split()
    far[::6] = ["changed"] * len(far[::6])
    texts = [(1000, "before it, " + items[0].upper().replace(" ", ", ") + ". After it"), (1001, items[1]),
             (1002, "x y z " + " ".join(near) + " z"), (1003, " ".join(far)), (1004, items[2][:60]),
             (None, items[1] + " and " + items[0])]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, ""), (11, "short item")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(more, bench).collect()}
    assert set(got) == {(1000, 0), (1001, 1), (1002, 3), (None, 0), (None, 1)}
    assert (got[1000, 0].start_word, got[1000, 0].n_words, got[1000, 0].similarity) == (2, 15, 1.0)
    assert 0.8 <= got[1002, 3].similarity < 1
    kept = without_leaks(more, bench)
    assert kept.columns == more.columns and kept.count() == more.count() - 4
    assert find_leaks(empty, bench).collect() == [] and find_leaks(more, bench.limit(0)).collect() == []


# ---- packing ---------------------------------------------------------------

def best_fit_by_force(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fit = [(capacity - sum(p[0] for p in b), i) for i, b in enumerate(bins)
               if capacity - sum(p[0] for p in b) >= length
               and not any((source is not None and p[1] == source) or (cluster is not None and p[2] == cluster) for p in b)]
        at = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        out.append((at, sum(p[0] for p in bins[at])))
        bins[at].append((length, source, cluster))
    return out


def test_pack_takes_the_tightest_compatible_bin():
    rng = random.Random(11)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 60), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, 4, 5]))
                         for _ in range(60)), key=lambda p: -p[0])
        assert packing.pack(pieces, 64) == best_fit_by_force(pieces, 64)


def test_packed_documents_do_not_share_near_copies_or_names(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"edit{i}", *base[31:]]) if i else " ".join(base), f"s{i}") for i in range(4)]
    rows += [(None, " ".join(f"x{i}" for i in range(300)), "a"), (None, " ".join(f"y{i}" for i in range(300)), "b")]
    rows += [(9, " ".join(f"z{i}" for i in range(300)), "c")] * 2
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), 256).collect()
    held = collections.Counter()
    for r in got:
        held[r.sequence_id] += r.length
    assert len(got) == 4 + 2 * 4 and max(held.values()) <= 256 and len([r for r in got if r.length == 256]) == 4
    assert len({r.sequence_id for r in got if r.length == 256}) == 4
    assert len({r.sequence_id for r in got if r.doc_id in range(4)}) == 4


def test_packing_splits_texts_into_words_once(docs, corpus, plan_of):
    got = packing.pack_documents(docs, 64)
    assert "regexp" not in plan_of(got).lower()
    assert sum(r.length for r in got.collect()) == sum(len(words(t)) + 1 for _, t in corpus)


def test_best_fit(spark, empty):
    rng = random.Random(12)
    rows = [(i, rng.randint(0, 300), rng.choice(["hot", "hot", f"s{i % 7}", None]), rng.choice([None, i % 40])) for i in range(900)]
    rows += [(5, 90, "s1", 3), (None, 50, "x", 1), (901, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    got = packing.best_fit(df, 128).collect()
    assert collections.Counter((r.doc_id, r.length) for r in got) == collections.Counter(
        (i, part) for i, n, _, _ in rows for part in [128] * ((n or 0) // 128) + ([(n or 0) % 128] if (n or 0) % 128 else []))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    of = {i: (s, c) for i, _, s, c in rows if i != 5}
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.position):
            assert r.position == at
            at += r.length
        assert at <= 128
        for column in (0, 1):
            held = [of[r.doc_id][column] for r in members if r.doc_id in of and of[r.doc_id][column] is not None]
            assert len(held) == len(set(held))
    assert {tuple(r) for r in packing.best_fit(df.repartition(1), 128).collect()} == {tuple(r) for r in got}
    assert packing.pack_documents(empty).collect() == []
