import re

import numpy as np
import pyarrow as pa
import pytest

from storyline.llm.words import bytes_of, join_hashes, packed, ranges, slices, split_words, windows

TEXTS = ["", " ", "a", "  two words\n", None, "été\tnaïve x", "a b c d e f", "A\x0bB\x0cC\x1fD", " no blank", "x" * 5000]


def words_of(texts, **kw):
    w = split_words(*bytes_of(pa.array(texts, pa.string())), **kw)
    return w, [[w.data[w.start[i]:w.end[i]].tobytes() for i in range(w.first[t], w.first[t + 1])] for t in range(w.texts)]


def test_words_are_those_of_the_pattern():
    want = [[m.encode() for m in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in TEXTS]
    assert words_of(TEXTS)[1] == want


def test_texts_that_touch_are_apart():
    assert words_of(["ab", "cd", "", "ef "])[1] == [[b"ab"], [b"cd"], [], [b"ef"]]


def test_lower_case_is_ascii_only():
    assert words_of(["ÀB Zé"], lower=True)[1] == [["Àb".encode(), "zé".encode()]]


def test_hashes_follow_content_only():
    w, words = words_of(["x yy zzz x", "zzz x"])
    h = w.hashes()
    assert h[0] == h[3] == h[5] and h[2] == h[4] and len(set(h.tolist())) == 3
    many, names = words_of([" ".join(f"w{i}" for i in range(200_000))])
    assert len(np.unique(many.hashes())) == 200_000
    again, _ = words_of(["w7 " * 3 + " ".join(f"w{i}" for i in range(200_000))])
    assert (again.hashes()[3:] == many.hashes()).all()


def test_joined_hashes_and_windows():
    w, _ = words_of(["a b c d", "b c d", "c"])
    h = join_hashes(w.hashes(), 3)
    assert windows(w, 3).tolist() == [True, True, False, False, True, False, False, False]
    assert h[1] == h[4] and h[0] != h[1]


def test_slices_keep_rows_and_order():
    texts = ["a" * n for n in (10, 0, 500, 3, 700, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(slices([batch, batch.slice(2, 3), batch.slice(0, 0)], "t", 512))
    assert [v for p in parts for v in p.column(0).to_pylist()] == texts + texts[2:5]
    assert max(len(p) for p in parts) < len(texts)


def test_packed_and_ranges():
    assert packed(np.frombuffer(b"abcd", np.uint8), np.array([0, 1, 1, 4])).to_pylist() == [b"a", b"", b"bcd"]
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


@pytest.mark.parametrize("texts", [[], [None], [""]])
def test_nothing(texts):
    w, words = words_of(texts)
    assert words == [[]] * len(texts) and len(w.hashes()) == 0
