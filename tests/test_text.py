import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from storyline.functions import (break_long, caption_cards, clean_text, content_key, escape_caption,
                                 exceeds_cap, gain_db, hms, last_match, nfkc, params_hash,
                                 sentence_list, split_oversize_list, stamp_cs)
from storyline.functions.text import is_stable
from storyline.operators import min_text_filter, split_stories, split_stories_blocks, units


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn("t")).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("Rain fell all night. Nobody slept! Was the roof safe? It held.",
     ["Rain fell all night.", "Nobody slept!", "Was the roof safe?", "It held."]),
    ("Dr. Okoye weighed 2.25 grams of salt. Then lunch.", ["Dr. Okoye weighed 2.25 grams of salt.", "Then lunch."]),
    ("'Stay here.' Lena closed both doors.", ["'Stay here.'", "Lena closed both doors."]),
    ("The bell rang... but no one answered. Silence.", ["The bell rang... but no one answered.", "Silence."]),
    ("This is plan B. Follow it.", ["This is plan B. Follow it."]),
    ("(Prof. Adeyemi paid.", ["(Prof.", "Adeyemi paid."]),
    ("Ask for no.! Seven.", ["Ask for no.!", "Seven."]),
    ("It rained.” “And now?” (4 weeks.) later", ["It rained.”", "“And now?”", "(4 weeks.) later"]),
    ("Red.\u00a0Blue.  Green.", ["Red.", "Blue.", "Green."]),
    ("", []), ("   ", []),
])
def test_sentences(spark, text, expected):
    assert one(spark, text, sentence_list) == expected


@pytest.mark.parametrize("text, expected", [
    ("A voice – “halt” – rang out", 'A voice , "halt" , rang out'),
    ("***Loud*** _low_ `x = 1`\n### Notes\n\nend", "Loud low x = 1 Notes end"),
    ("a <b>tag</b> , , , end , .", "a tag , end ."),
    ("wait… ﬁne\u200b \u00a0x", "wait... fine x"),
    ("`# no heading", "# no heading"),
    (None, None),
])
def test_clean_text(spark, text, expected):
    assert one(spark, text, clean_text) == expected


def test_nfkc_shortcut_agrees_with_python(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["e" + c + "e" for c in chars] + ["".join(chars[i:i + 7]) for i in range(0, len(chars), 7)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc("t").alias("n")).collect()
    # the ellipsis and the no-break space are settled by the character table
    settle = str.maketrans({"…": "...", "\u00a0": " "})
    assert [r.t for r in rows if r.n.translate(settle) != unicodedata.normalize("NFKC", r.t)] == []


@pytest.mark.parametrize("text", [
    "Plain words, naïve cafés & 3 × 4.", "Ελληνικά γράμματα χωρίς τόνους συμβατότητας", "Съешь ещё этих мягких французских булок",
    "汉字和假名ひらがなカタカナ漢字交じり文", "한국어 문장도 그대로", "emoji 🎉🚀 stay", "שלום עולם", "", "…\u00a0—"])
def test_texts_without_compatibility_characters_stay_in_the_jvm(spark, text):
    assert one(spark, text, is_stable)


@pytest.mark.parametrize("text", ["ﬁne", "e\u0301", "½", "ｗｉｄｅ", "한".encode().decode() + "\u11a8", "x²", "\u2126"])
def test_texts_that_change_do_not(spark, text):
    assert not one(spark, text, is_stable)
    assert one(spark, text, nfkc) == unicodedata.normalize("NFKC", text)


@pytest.mark.parametrize("sentence, pieces", [
    # the last pause within both limits, its mark becomes a comma
    ("one two three four five six, and seven eight nine; ten eleven twelve", ["one two three four five six,", "and seven eight nine; ten eleven twelve"]),
    # a pause before the twentieth character is none; half of the words, commas at the cut go
    ("aa bb, so cc dd ee ff, gg hh ii jj kk ll", ["aa bb, so cc dd ee", "ff, gg hh ii jj kk ll"]),
    # inside a word
    ("alpha beta gamma delta:epsilon zeta eta theta iota", ["alpha beta gamma delta,", "epsilon zeta eta theta iota"]),
    ("a b c d e f g h", ["a b c d e f g h"]),
])
def test_break_long_at_pauses(sentence, pieces):
    assert break_long(sentence, 8, 45) == pieces


def test_only_long_sentences_are_cut(spark):
    long = " ".join(f"w{i}" for i in range(31))
    rows = [["short", long, "", long, "last"], [], None, ["short"], [None, "x"]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<string>")
    halves = [" ".join(f"w{i}" for i in range(15)), " ".join(f"w{i}" for i in range(15, 31))]
    assert [r[0] for r in df.select(split_oversize_list("s")).collect()] == [
        ["short", *halves, "", *halves, "last"], [], None, ["short"], [None, "x"]]


def test_break_long_limits_and_words(spark):
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["and", "so", "word", "longerword", "x" * rng.randint(1, 40), "pause;", "stop,", "a:b"])
                 for _ in range(rng.randint(1, 150))]
        parts = break_long(" ".join(words), 30, 200)
        assert all(len(p.split()) <= 30 for p in parts)
        assert all(len(p) <= 200 or len(p.split()) <= 4 for p in parts)
        keep = str.maketrans("", "", " ,;:")
        assert "".join(parts).translate(keep) == "".join(words).translate(keep)


def test_break_long_keeps_a_piece_without_a_cut(spark):
    assert break_long("x" * 250, 30, 200) == ["x" * 250]
    long = " ".join(f"w{i}" for i in range(31))
    assert one(spark, long, lambda c: split_oversize_list(F.array(c))) == [
        " ".join(f"w{i}" for i in range(15)), " ".join(f"w{i}" for i in range(15, 31))]


def test_caption_cards(spark):
    words = "the quick brown fox jumps over the lazy dog and then runs home again because it is late and very cold".split()
    cards = one(spark, " ".join(words), caption_cards)
    assert " ".join(cards).split() == words
    assert all(len(c.split()) <= 8 and len(c) <= 46 for c in cards)
    nine = one(spark, "one two three four five six seven eight nine", caption_cards)
    assert nine == ["one two three four five six seven eight nine"]
    assert one(spark, "x" * 60 + " a", caption_cards) == ["x" * 60 + " a"]


def brute_stories(text):
    """The rule as a plain loop over lines; delimiter lines are --- or === Title here."""
    stories, title, blocks, para = [], None, [], []

    def close():
        nonlocal para
        if para:
            blocks.append("\n".join(para).strip())
        para = []

    def flush():
        kept = [b for b in blocks if b]
        if title is not None or kept:
            stories.append((title, kept))

    for line in text.split("\n"):
        name = line[3:].strip() if line.startswith(("---", "===")) else None
        if name is not None and (name or blocks or para):
            close()
            flush()
            title, blocks = name or None, []
        elif not line.strip():
            close()
        else:
            para.append(line)
    close()
    flush()
    return stories


def test_split_stories_random(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["a b", "---", "", "=== T", " ", "c"]) for _ in range(rng.randint(1, 14)))
             for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in split_stories(df, ["id"]).orderBy("id", "story_idx").collect():
        got.setdefault(r.id, []).append((r.title, list(r.paragraphs)))
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute_stories(text), text


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stories_of_blocks_are_those_of_whole_files(spark, size):
    rng = random.Random(size)
    texts = ["\n".join(rng.choice(["a b", "---", "---", "", "=== T", " ", "c"]) for _ in range(rng.choice([1, 3, 30, 90])))
             for _ in range(400)]
    lines = [(i, at // size, at, line) for i, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "id int, block int, at int, line string").repartition(4)
    got = {}
    for r in split_stories_blocks(df, ["id"]).orderBy("id", "story_idx").collect():
        assert r.story_idx == len(got.setdefault(r.id, []))
        got[r.id].append((r.title, list(r.paragraphs)))
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute_stories(text), text


@pytest.mark.parametrize("order", [("at",), ("at", "sub"), ("name",), ("name", "at")])
def test_stories_of_ranges_are_those_of_whole_files(spark, order):
    """Blocks are cut where ``at`` passes a multiple of 1,024, some inside one line; null is a file and a line as well."""
    rng = random.Random(len(order))
    texts = ["\n".join(rng.choice(["a b", "---", "---", "", "=== T", " ", "\ufdd0c"]) for _ in range(rng.choice([1, 3, 30, 90])))
             for _ in range(300)]
    lines = []
    for i, text in enumerate(texts):
        at = -3000
        for n, line in enumerate(text.split("\n")):
            at += rng.choice([1, 400, 5000]) if len(order) == 1 or n % 3 else 0
            lines.append((i or None, n // 20, at, n - 40, f"{n:09}", line or None))
    df = spark.createDataFrame(rng.sample(lines, len(lines)), "id int, block int, at long, sub int, name string, line string")
    got = {}
    for r in split_stories_blocks(df.repartition(5), ["id"], order=order).orderBy("id", "story_idx").collect():
        assert r.story_idx == len(got.setdefault(r.id or 0, []))
        got[r.id or 0].append((r.title, list(r.paragraphs)))
    for i, text in enumerate(texts):
        assert got.get(i, []) == brute_stories(text), text


def test_units_number_sentences_through_a_story(spark):
    df = spark.createDataFrame([(1, "STORY: One\nFirst here. Then there.\n\nLast one.\n\nstory # Two\nOnly.")],
                               "id int, text string")
    rows = units(split_stories(df, ["id"]), ["id"]).orderBy("story_idx", "sent_idx").collect()
    assert [r.story_idx for r in rows] == [0, 0, 0, 1]
    assert [r.sent_idx for r in rows] == [0, 1, 2, 0]
    assert [r.ends_story for r in rows] == [False, False, True, True]


def test_units_plan_computes_each_text_step_once(spark, plan_of):
    df = spark.createDataFrame([(1, ["a. B."])], "id int, paragraphs array<string>").withColumn("story_idx", F.lit(0))
    plan = plan_of(units(df, ["id"]))
    assert plan.count("ArrowEvalPython") == 2 and "Exchange" not in plan
    assert plan.count("{1,80}") == 1


def test_min_text_filter(spark):
    df = spark.createDataFrame([(" " * 50 + "x",), ("y" * 40,)], "t string")
    assert [r.t for r in min_text_filter(df, "t").collect()] == ["y" * 40]


def test_scalars(spark):
    row = spark.range(1).select(
        stamp_cs(F.lit(3600000)).alias("a"), stamp_cs(F.lit(3602500)).alias("b"), stamp_cs(F.lit(25.0)).alias("half"),
        hms(F.lit(3661999.9)).alias("h"), escape_caption(F.lit("evil {b} tag\nx")).alias("e"),
        gain_db(F.lit(-18.7)).alias("g1"), gain_db(F.lit(-40.0)).alias("g2"), gain_db(F.lit(0.0)).alias("g3"),
        gain_db(F.lit(None).cast("double")).alias("g4"), exceeds_cap(F.lit("abc"), 1).alias("c1"),
        exceeds_cap(F.lit("11"), 10).alias("c2"), exceeds_cap(F.lit(10), 10).alias("c3")).first()
    assert (row.a, row.b, row.half, row.h) == ("1:00:00.00", "1:00:02.50", "0:00:00.02", "1:01:01")
    assert row.e == "evil (b) tag\\Nx"
    assert (row.g1, row.g2, row.g3, row.g4) == (2.7, 12.0, -12.0, 0.0)
    assert (row.c1, row.c2, row.c3) == (False, True, False)


def test_last_match(spark):
    pattern = r"I:\s+(-?\d+(?:\.\d+)?)\s+LUFS"
    assert one(spark, "I: -3.0 LUFS\nI: -18.7 LUFS", lambda c: last_match(c, pattern, "double")) == -18.7
    assert one(spark, "nothing", lambda c: last_match(c, pattern, "double")) is None


def test_content_key_is_canonical_and_sensitive(spark):
    def key(t, v, s):
        return spark.range(1).select(content_key(F.lit(t), F.lit(v), F.lit(s))).first()[0]
    assert key("a", "v", 1) == key("a", "v", 1.0) == key("a", "v", "1")
    assert len({key("a", "v", 1), key("b", "v", 1), key("a", "w", 1), key("a", "v", 1.25)}) == 4


def test_params_hash(spark):
    def h(m):
        return spark.createDataFrame([(m,)], "m map<string,string>").select(params_hash("m")).first()[0]
    assert h({"a": "1", "b": "2"}) == h({"b": "2", "a": "1"}) == h({"a": "1", "b": "2", "eq": None})
    assert h({"a": "1", "b": "2"}) != h({"a": "1", "b": "3"})
