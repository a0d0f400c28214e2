"""Phrases, conversation tries and page texts against brute force."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm.collocations import count_phrases, count_words, equal_partitions, mine_phrases
from storyline.llm.html_dom import Page
from storyline.llm.prefix_trie import identified_turns, prefix_trie, swapped_heads
from storyline.llm.radix import Full, Indexed, RadixTree
from storyline.llm.rows import Steps
from storyline.llm.site_trees import importance_of, with_main_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ---- phrases ----------------------------------------------------------------

def test_equal_partitions_are_the_counts_of_all_prefixes():
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        n = rng.choice([2, 3, 3, 3])
        rows.append([rng.choice([1, 2, 3, 2**63 + 5, 9]) if d == 0 else rng.randint(1, 40) for d in range(n)] + [0] * (3 - n))
    weight = np.array([rng.randint(1, 3) for _ in rows])
    want = collections.Counter()
    for row, w in zip(rows, weight):
        for d in (1, 2, 3):
            if row[d - 1]:
                want[tuple(row[:d])] += int(w)
    keys = np.array(rows, np.uint64)
    for least in (0, 1, 10, 60):
        got = {}
        for depths, at, sums in equal_partitions(keys, weight, [least] * 3):
            for d, i, s in zip(depths, at, sums):
                assert tuple(rows[i][:d]) not in got
                if s >= least:
                    got[tuple(rows[i][:d])] = int(s)
        assert got == {k: n for k, n in want.items() if n >= least}
    assert not list(equal_partitions(keys[:0], weight[:0], [1] * 3))


def brute_phrases(rows, top, least, max_words, share):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, max_words + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def chat():
    rng = random.Random(8)
    vocabulary = ["to", "be", "or", "not", "Straße", "New", "york", "city", "é", "x" * 40, "co-op", " "]
    rows = [(None, "en"), ("", "en"), (" \t\n.,", None), ("No. No! no", ""), ("New York City, new york", None)]
    rows += [("new york city hall " * 30, "en"), ("to be or not to be; " * 400, "en")]
    for i in range(500):
        words = [rng.choice(vocabulary[:rng.choice([3, 12])]) for _ in range(rng.randint(0, 60))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b"]) for w in words),
                     rng.choice(["en", "en", "en", "de", None, "", "fr"])))
    rows += [rows[20]] * 15
    return rows


@pytest.fixture(scope="module")
def chats(spark, chat):
    rows = [(t, g, "w0", 1, "deep") for t, g in chat]
    return spark.createDataFrame(rows, "text string, lang string, w0 string, n int, word string").repartition(5)


@pytest.mark.parametrize("top, least, max_words, share", [(2000, 10, 3, 50), (7, 4, 4, 80), (50, 2, 2, 50)])
def test_phrases(chats, chat, top, least, max_words, share):
    got = mine_phrases(chats, top, least=least, max_words=max_words, share=share).collect()
    assert sorted(map(tuple, got)) == brute_phrases(chat, top, least, max_words, share)


def test_counts_do_not_depend_on_routes_and_buckets(spark, chats, chat):
    docs = chats.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = Steps(spark).write(count_words(docs))

    def counts(**settings):
        return {tuple(r.ws): r.f for r in count_phrases(docs, words, 5, 4, **settings).collect()}

    plain = counts()
    assert len(plain) > 100
    for hot_from, bucket_rows in ((1, 1 << 20), (50, 500), (300, 100)):
        assert counts(hot_from=hot_from, bucket_rows=bucket_rows) == plain


def test_no_phrases(spark):
    schema = "text string, lang string"
    assert mine_phrases(spark.createDataFrame([], schema), 5).collect() == []
    assert mine_phrases(spark.createDataFrame([(None, None), ("one two", "en")], schema), 5).collect() == []


# ---- conversations ----------------------------------------------------------

def test_radix_tree_counts_prefixes_of_whole_turns():
    rng = random.Random(1)
    turns = [bytes([rng.choice([0, 0, 255]), rng.randrange(256), rng.choice([0, 7])]) for _ in range(300)]
    turns += [bytes([9, i, 1]) for i in range(256)]     # grows through every layout
    keys = [b"".join(rng.choice(turns[:rng.choice([3, 40, 556])]) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    keys += [b"".join(turns[:200]), turns[0], *turns]
    tree, want = RadixTree(), {}
    for i, key in enumerate(keys):
        tree.insert(key, i, i % 3 + 1, -i)
        for d in range(1, len(key) // 3 + 1):
            count, least = want.get(key[:3 * d], (0, 0))
            want[key[:3 * d]] = count + i % 3 + 1, min(least, -i)
    got = {}
    for d, i, count, least in tree.aligned(3):
        assert keys[i][:3 * d] not in got
        got[keys[i][:3 * d]] = count, least
    assert got == want
    kinds, stack = set(), [tree.root]
    while stack:
        node = stack.pop()
        kinds.add(getattr(node.children, "room", None))
        stack += [n for _, n in node.children.items()]
    assert kinds == {4, 16, Indexed.room, Full.room}


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        built[c] = own.get(base, [])[:h] + ts[h:]
    nodes = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    saved, leaves, children = collections.Counter(), collections.Counter(), collections.Counter()
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
            leaves[p[:d]] += not children[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


def trie(df):
    rows = prefix_trie(*swapped_heads(identified_turns(df))).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


TURNS = "conv_id long, turn long, role string, text string, node string, c int, pos string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(4)


def test_trie(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "Hello there", "hello there", "one word", "a b\tc\x0bd", *[f"text {i} of many" for i in range(12)]]
    rows = []
    for c in [*range(0, 130), 140, 161, 205, -3, -25, -40, 10**12]:
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randint(1, 7)):
            rows.append((c, None if turn == 0 and c % 5 == 0 else turn, rng.choice([None, "", "user", "user"]), rng.choice(texts[:rng.choice([4, 19])])))
    rows += [(500 + i, t, "user", f"long {t}") for i in range(3) for t in range(150 + 40 * i)]      # stretches
    rows += [(600 + i, t, "system", "the same for all") for i in range(60) for t in range(3)]
    rows += [(700, 5, "user", "twice"), (700, 5, "user", "twice"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    assert trie(turns_of(spark, rows)) == brute_trie(rows)


def test_small_tries(spark):
    assert trie(turns_of(spark, [])) == []
    assert trie(turns_of(spark, [(None, 1, "user", "x")])) == []
    short = [(c, 0, "user", "x") for c in (1, 2, 3, 21)]     # some are left without turns
    assert trie(turns_of(spark, short)) == brute_trie(short)


# ---- pages ------------------------------------------------------------------

def text_of(html):
    page = Page(html)
    return [t for _, t in page.blocks]


@pytest.mark.parametrize("html, blocks", [
    ("", []), ("<", ["<"]), ("a < b <c", ["a < b"]), ("<p>one<p>two", ["one", "two"]),
    ("<p>a <b>bold\n\t<i>text</b></i> end</p>tail", ["a bold text end", "tail"]),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", ["x", "y", "z", "w"]),
    ("<script>var t='</p><p>no'</script>yes<style>p{}</STYLE >!", ["yes!"]),
    ("<!-- <p>no</p> -->a<!-- open", ["a"]), ("&lt;p&gt; &amp;amp; &#233; &am", ["<p> &amp; é &am"]),
    ("<p title='a>b' class=x>in</p>", ["in"]), ("<p title=\"open>text", ["text"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("x<br>y<hr>z", ["x y", "z"]),
    ("<div><p>in</div>out</p>!", ["in", "out", "!"]), ("</div>stray", ["stray"]),
])
def test_blocks(html, blocks):
    assert text_of(html) == blocks


def test_endless_input_is_read_in_linear_time():
    for html in ("<" * 200_000, "<a b=\"" * 50_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "<p a" + " a=" * 100_000, "<script>" * 30_000):
        Page(html)


def site(n, frame, host="site.example"):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for i in range(n):
        body = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(rng.randint(1, 6))]
        out.append((i, f"https://{host}/p/{i}", frame(i, "".join(f"<p>{b}" for b in body)), "\n".join(body)))
    return out


def plain_frame(i, body):
    return (f"<body><div class=a1><a href=/>Home</a> <a href=/x>All articles</a></div><div class=b2>We use crumbs. Accept?</div>"
            f"<div class=c3>{body}</div><div class=d4>Read also: article {['one', 'two'][i % 2]}</div><div><p>All rights kept</div></body>")


def semantic_frame(i, body):
    return (f"<html><head><title>t {i}</title><style>x</style></head><body class='page has-sidebar'><header><h1>Site</h1></header>"
            f"<nav><ul><li>a{i}<li>b</ul></nav><form id=aspnetForm><main><article><header><h2>Heading {i}</h2></header>{body}"
            f"<ul><li>point {i}</li></ul><aside>aside {i}</aside><div class='ad-slot ad'>buy {i}</div></article>"
            f"<ol class=commentlist><li>Nice, {i}</ol><div class='cookieBanner'>We use them</div><section id=comments><article class=comment><p>I, reader {i}, think so</p></article></section></main></form>"
            f"<div role=complementary>more {i}</div><footer>&copy; {i}</footer><p hidden>x</p></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    plain, semantic = site(30, plain_frame, "USER@Plain.example:80"), site(9, semantic_frame, "single")
    rows = [(i, u, h, t) for i, u, h, t in plain]
    # each on a host of its own, so that only the markup tells
    rows += [(100 + i, f"http://h{i}.example/", h, f"Heading {i}\n{t}\npoint {i}") for i, _, h, t in semantic]
    rows += [(200, None, None, ""), (201, "http://x.example", "", ""), (202, None, "<p>no site", "no site"), (203, "not a url", " only text ", "only text")]
    # copies of one page alone on a host: nothing to compare with
    rows += [(300 + i, "https://copies.example/a", plain[0][2], None) for i in range(40)]
    rows += [rows[3], (400, "https://long.example/", "<div><p>" + "long text " * 60_000 + "</div>", ("long text " * 60_000).strip())]
    return rows


def test_main_text(spark, pages):
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in pages],
                                  "page_id long, url string, html string, page string, element int").repartition(4)
    got = with_main_text(table)
    assert got.columns == [*table.columns, "text"]
    want = {i: t for i, _, _, t in pages}
    rows = got.collect()
    assert sorted((r.page_id, r.url or "", "-" if r.html is None else r.html) for r in rows) == sorted(
        (i, u or "", "-" if h is None else h) for i, u, h, _ in pages)
    for r in rows:
        if want[r.page_id] is not None:
            assert r.text == want[r.page_id], r.page_id
        assert r.page == "x" and r.element == 1
    with pytest.raises(ValueError):
        with_main_text(table, out="URL")
    assert with_main_text(table.limit(0)).collect() == []


def test_importance_is_the_entropy(spark):
    rows = [(p, 1, p % 2, [7, 100 + p]) for p in range(8)] * 2 + [(p, 2, 5, []) for p in range(8)] + [(1, 3, 1, [1])]
    got = {r.element: (r.look, r.content, r.ways) for r in importance_of(
        spark.createDataFrame(rows, "page long, element long, style long, texts array<long>")).collect()}
    # two ways of four pages each: log8 2; one text on all 8 pages and 8 texts on one each
    assert got == {1: (round(1 / 3, 9), round(1 - 1 / 9, 9), 2), 2: (0.0, None, 1)}
