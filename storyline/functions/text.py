"""Text normalisation and segmentation as column expressions.

A text is one row, so everything here is narrow: no token is exploded and no
shuffle is needed to put sentences together again.  Python is only entered for
the few rows that contain characters Unicode normalisation can change, and for
sentences over the length limits; all other rows send a null across.
"""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

__all__ = [
    "break_long", "caption_cards", "clean_text", "has_oversize", "nfkc",
    "nfkc_each", "sentence_list", "split_oversize_list", "trim_ws", "tidy_text",
    "word_count", "words_of",
]

# Fixed values (must equal the reference's).
# Terms whose trailing dot does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "sr", "jr", "st", "vs", "etc", "e.g", "i.e",
    "u.s", "u.k", "no", "gen", "hon", "prof", "inc", "ltd", "co", "ave",
    "blvd", "rd", "dept", "approx", "min", "max", "jan", "feb", "mar",
    "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
SENTENCE_MARKS = ".!?…"
CLOSERS = "\"'”’»)\\]"
OPENERS = "\"'“‘”’(—\\-–\\["
ABBREVIATION_TAIL = ".\"'”’»\\])"
MAX_SENTENCE_WORDS = 30
MAX_SENTENCE_CHARS = 200
MIN_PAUSE_POSITION = 20
PAUSE = r",\s+(?:and|but|so|yet)\b|[;:]"
MAX_CARD_WORDS = 8
MAX_CARD_CHARS = 42
# Single characters and what they become; the ones without a partner vanish.
CHARS_FROM = "‘’‚“”„—–\u00a0\u200b\u200c\u200d*_"
CHARS_TO = "'''\"\"\",, "

# Unicode white space, to stand inside a Java character class.
WS = r"\s\x1c-\x1f\x85\p{Z}"

# Characters below U+0180 that compatibility composition leaves alone wherever they
# stand, or that the character table above maps to the same result by itself.
_STABLE_LATIN = (r"\x00-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e"
                 r"\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u2026\u20ac")
_LEAST_RUN = 24


@lru_cache(maxsize=1)
def stable_pattern() -> str:
    """Texts that NFKC leaves alone, in any script.

    A character is stable if it maps to itself, does not combine, and is not the
    second half of a composition.  Long runs of such characters make the class, so
    that it stays short; what lies in short runs goes the slow way.
    """
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))     # Hangul vowels and finals
    for c in range(0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    runs, start = [], None
    for c in range(0x180, 0x30001):
        t = chr(c)
        stable = (c < 0x30000 and not 0xD800 <= c < 0xE000 and c not in second and not unicodedata.combining(t)
                  and unicodedata.normalize("NFKC", t) == t)
        if stable and start is None:
            start = c
        elif not stable and start is not None:
            if c - start >= _LEAST_RUN:
                runs.append(rf"\x{{{start:x}}}-\x{{{c - 1:x}}}")
            start = None
    return f"^[{_STABLE_LATIN}{''.join(runs)}]*+$"


def is_stable(text) -> Column:
    """Whether NFKC leaves a text alone; the long class is only tried where the short one fails."""
    return _col(text).rlike(f"^[{_STABLE_LATIN}]*+$") | _col(text).rlike(stable_pattern())


_SPLIT = "\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(text) -> Column:
    # the look-behind lets a long inner run of blanks be tried once, not from each blank
    return F.regexp_replace(_col(text), rf"\A[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def words_of(text) -> Column:
    """White-space separated tokens as an array, without empty ones."""
    return F.filter(F.split(_col(text), rf"[{WS}]+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.regexp_count(_col(text), F.lit(rf"[^{WS}]+"))


# ---- normalisation ---------------------------------------------------------

def _normalised(texts: pa.Array) -> pa.Array:
    # pyarrow's utf8_normalize leaves NFKC decomposed
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc_udf(texts: pa.Array) -> pa.Array:
    return _normalised(texts)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each_udf(lists: pa.Array) -> pa.Array:
    return _over_lists(lists, _normalised)


def _over_lists(lists: pa.Array, fn) -> pa.Array:
    """``fn`` over the values of all lists at once."""
    done = pa.ListArray.from_arrays(pa.array(pc.cumulative_sum(pa.concat_arrays(
        [pa.array([0], pa.int32()), pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())]))), fn(lists.flatten()))
    return pc.if_else(lists.is_valid(), done, None)


def nfkc(text) -> Column:
    """NFKC; only rows it may change travel to Python."""
    c = _col(text)
    return F.coalesce(_nfkc_udf(F.when(~is_stable(c), c)), c)


def nfkc_each(texts) -> Column:
    """NFKC over an array of texts, with the same short cut."""
    c = _col(texts)
    touched = F.exists(c, lambda t: ~is_stable(t))
    return F.coalesce(_nfkc_each_udf(F.when(touched, c)), c)


def tidy_text(text) -> Column:
    """The part of ``clean_text`` after NFKC; plain expressions only."""
    t = F.translate(_col(text), CHARS_FROM, CHARS_TO)
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, rf"(?md)^#{{1,6}}[{WS}]+", "")
    t = F.replace(t, F.lit("`"), F.lit(""))
    t = F.regexp_replace(t, r"<[^>\n]{1,80}>", " ")
    t = F.regexp_replace(t, rf",[{WS},]*,[{WS}]*", ", ")
    t = F.regexp_replace(t, rf",[{WS}]*\.", ".")
    t = F.regexp_replace(t, rf"[{WS}]+", " ")
    return F.trim(t)


def clean_text(text, nfkc_first: bool = True) -> Column:
    return tidy_text(nfkc(text) if nfkc_first else text)


# ---- sentences -------------------------------------------------------------

def _boundary_pattern() -> str:
    """One token that ends a sentence, with its blank, before a sentence start."""
    abbreviations = "|".join(re.escape(a) for a in ABBREVIATIONS)
    no_end = rf"(?:(?i:{abbreviations})|\p{{L}})[{ABBREVIATION_TAIL}]* "
    end = rf"[^ ]*[{SENTENCE_MARKS}][{CLOSERS}]*"
    start = rf"[{OPENERS}]*[\p{{IsUppercase}}\p{{Nd}}]"
    return rf"(?<![^ ])(?!{no_end})({end}) (?={start})"


def sentence_list(text, normalised: bool = False) -> Column:
    """Sentences of one text, in order.

    Whether a token ends a sentence depends on it and the next token only, so
    one regular expression marks all boundaries in one pass.
    """
    t = _col(text)
    if not normalised:
        t = F.trim(F.regexp_replace(t, rf"[{WS}]+", " "))
    marked = F.regexp_replace(t, _boundary_pattern(), "$1" + _SPLIT)
    return F.filter(F.split(marked, _SPLIT), lambda s: s != "")


def _too_long(sentence: Column, max_words: int, max_chars: int) -> Column:
    # the sentence is single-spaced, so its words are its blanks plus one
    blanks = F.length(sentence) - F.length(F.translate(sentence, " ", ""))
    return (F.length(sentence) > max_chars) | (blanks >= max_words)


def has_oversize(sentences, max_words: int = MAX_SENTENCE_WORDS,
                 max_chars: int = MAX_SENTENCE_CHARS) -> Column:
    return F.exists(_col(sentences), lambda s: _too_long(s, max_words, max_chars))


_PAUSE = re.compile(PAUSE, re.IGNORECASE)
_TRIM = " ,;:"


def break_long(sentence: str, max_words: int, max_chars: int) -> list[str]:
    """Cut one over-long, single-spaced sentence at its natural pauses.

    Every piece is a span of the sentence.  Where words and pauses begin is found
    once; each cut is then looked up: the last pause that lies within both limits,
    or else half of the words, four at least.  A piece of at most four words over the
    character limit has no place to be cut and stays whole.
    """
    words = [m.start() for m in re.finditer(r"[^ ]+", sentence)]
    pauses = [m.start() for m in _PAUSE.finditer(sentence)]
    spans, pieces = [(0, len(sentence), "")], []

    def word(begin: int, n: int) -> int:
        """Where word n of a span begins; a span may begin inside a word of the sentence."""
        at = bisect_right(words, begin) - 1 + n
        return words[at] if n and at < len(words) else begin if not n else len(sentence)

    while spans:
        begin, end, tail = spans.pop()
        count = bisect_left(words, end) - bisect_right(words, begin) + (begin < end)
        if count <= max_words and end - begin + len(tail) <= max_chars:
            pieces.append(sentence[begin:end] + tail)
            continue
        # a pause that begins a word still has only the words before it
        last = min(end, begin + max_chars) - 1
        if count > max_words:
            last = min(last, word(begin, max_words))
        found = bisect_right(pauses, last)
        pause = pauses[found - 1] if found else -1
        if pause - begin >= MIN_PAUSE_POSITION:
            left, right, mark = pause, pause + 1, ","
        else:
            half = max(4, min(max_words, count // 2))
            if half >= count:
                pieces.append(sentence[begin:end] + tail)
                continue
            left = right = word(begin, half)
            mark = ""
        kept = sentence[begin:left].rstrip(_TRIM)
        rest = len(sentence[right:end]) - len(sentence[right:end].lstrip(" "))
        spans += [(right + rest, end, tail), (begin, begin + len(kept), mark)]
    return [p for p in pieces if p]


def _break_udf(max_words: int, max_chars: int):
    def cut(lists: pa.Array) -> pa.Array:
        return _over_lists(lists, lambda texts: pa.array(
            [t if t is None else break_long(t, max_words, max_chars) for t in texts.to_pylist()], pa.list_(pa.string())))
    return F.arrow_udf(cut, T.ArrayType(T.ArrayType(T.StringType())))


def split_oversize_list(sentences, max_words: int = MAX_SENTENCE_WORDS,
                        max_chars: int = MAX_SENTENCE_CHARS) -> Column:
    """Sentences with the over-long ones cut; only these travel to Python, nulls in place of the others."""
    s = _col(sentences)
    some = has_oversize(s, max_words, max_chars)
    cut = _break_udf(max_words, max_chars)(F.when(some, F.transform(s, lambda x: F.when(_too_long(x, max_words, max_chars), x))))
    return F.when(some, F.flatten(F.zip_with(s, cut, lambda x, pieces: F.coalesce(pieces, F.array(x))))).otherwise(s)


# ---- caption cards ---------------------------------------------------------

def caption_cards(sentence, max_words: int = MAX_CARD_WORDS,
                  max_chars: int = MAX_CARD_CHARS, normalised: bool = False) -> Column:
    """Greedy packing of words into cards; a one-word last card joins the one before.

    ``normalised`` says that the sentence is single-spaced already.
    """
    words = F.split(_col(sentence), " ") if normalised else words_of(sentence)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("cards"), F.lit("").alias("card"), F.lit(0).alias("n"))

    def step(acc: Column, word: Column) -> Column:
        full = (acc.n >= max_words) | (F.length(acc.card) + 1 + F.length(word) > max_chars)
        fresh = acc.n == 0
        closes = ~fresh & full
        return F.struct(
            F.when(closes, F.array_append(acc.cards, acc.card)).otherwise(acc.cards).alias("cards"),
            F.when(fresh | full, word).otherwise(F.concat(acc.card, F.lit(" "), word)).alias("card"),
            F.when(fresh | full, F.lit(1)).otherwise(acc.n + 1).alias("n"))

    def finish(acc: Column) -> Column:
        count = F.size(acc.cards)
        merged = F.array_append(
            F.slice(acc.cards, F.lit(1), F.greatest(count - 1, F.lit(0))),
            F.concat(F.try_element_at(acc.cards, F.lit(-1)), F.lit(" "), acc.card))
        return (F.when(acc.n == 0, empty)
                .when((acc.n == 1) & (count >= 1), merged)
                .otherwise(F.array_append(acc.cards, acc.card)))

    return F.aggregate(words, start, step, finish)
