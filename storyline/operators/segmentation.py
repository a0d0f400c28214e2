"""Script text to stories, sentences, cards and speech units.

All operators here but ``join_scripts`` and ``split_stories_blocks`` are narrow: one input row holds one text
(or one story), and its pieces are produced from that row alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import WORDS_PER_MINUTE, plan_budget_columns
from ..functions.text import (MAX_SENTENCE_CHARS, MAX_SENTENCE_WORDS, WS,
                              caption_cards, nfkc_each, sentence_list,
                              split_oversize_list, tidy_text, trim_ws, word_count)
from .running import running_before

MIN_SCRIPT_CHARS = 40

# Fixed value: what a story delimiter line looks like.
_DELIMITER = rf"(?isu)\A[{WS}]*(?:STORY[{WS}]*[:#]|={{3,}}|-{{3,}}|\*{{3,}})[{WS}]*(.*)\z"
_BLANK = rf"\A[{WS}]*\z"
_RANGE_BITS = 10    # lines of a block that are handled together: 1,024
# Letters that lead to each state a story can be in: nothing yet, a title, text.
_STATES = ("", "T", "Tt")
# A Unicode non-character: it cannot occur in interchanged text.
_MARK = "\ufdd0"


def min_text_filter(df: DataFrame, text_col: str, n: int = MIN_SCRIPT_CHARS) -> DataFrame:
    """Keep rows whose trimmed text has at least ``n`` characters."""
    return df.filter(F.length(trim_ws(text_col)) >= n)


def _explode(df: DataFrame, keep: list, items: Column, pos: str, item: str) -> DataFrame:
    """Items of an array with their positions, none for an empty array.

    The outer form plus a filter: for the plain form Catalyst adds a filter on
    the array's size and pushes it down, which computes the array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def _once(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """A column that is computed once, however often it is used further up.

    Catalyst copies a projected expression into each place that reads it; the
    output of a generator stays what it is.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _title(line: Column) -> Column:
    return trim_ws(F.regexp_extract(line, _DELIMITER, 1))


def _letter(line: Column) -> Column:
    """``b`` blank, ``t`` text, ``d`` bare delimiter, ``T`` titled delimiter."""
    return (F.when(line.rlike(_BLANK), "b")
            .when(line.rlike(_DELIMITER), F.when(_title(line) != "", "T").otherwise("d"))
            .otherwise("t"))


def _rendered(line: Column, kind: Column) -> Column:
    return (F.when(kind == "b", "").when(kind == "t", line)
            .when(kind == "T", F.concat(F.lit(_MARK), _title(line))).when(kind == "d", F.lit(_MARK)))


def split_stories(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``(id_cols, story_idx, title, paragraphs)``, one row per story.

    Every line becomes one letter.  A bare delimiter with no text between it and
    the start of its story is itself text; one replacement over the letters
    settles that for the whole file, because the letters between two such places
    can only be ``b`` and ``t``.  Then each story is a title line (maybe empty)
    and its body, behind a mark.
    """
    rows = _once(df, id_cols, F.split(F.translate(text_col, _MARK, ""), "\n"), "__lines")
    letters = F.regexp_replace(F.array_join(F.transform("__lines", _letter), ""),
                               r"(\Ab*|[Td]b*)d", "$1t")
    rows = _once(rows, [*id_cols, "__lines"], letters, "__letters")
    body = F.array_join(F.zip_with("__lines", F.split("__letters", ""), _rendered), "\n")
    # text before the first delimiter has no title line of its own
    head = F.when(F.col("__letters").rlike(r"\A[Td]"), "").otherwise(_MARK + "\n")
    texts = F.slice(F.split(F.concat(head, body), _MARK), F.lit(2), F.lit(2**30))

    found = F.filter(F.transform(texts, _story), lambda s: s.title.isNotNull() | (F.size(s.paragraphs) > 0))
    return _explode(rows, id_cols, found, "story_idx", "s").select(
        *id_cols, "story_idx", "s.title", "s.paragraphs")


def _story(text: Column) -> Column:
    """Title line and body of one story."""
    title = F.regexp_extract(text, r"\A([^\n]*)", 1)
    body = F.regexp_replace(text, r"\A[^\n]*", "")
    paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}"), trim_ws), lambda p: p != "")
    return F.struct(F.nullif(title, F.lit("")).alias("title"), paragraphs.alias("paragraphs"))


def _line_marks(letters: Column, state: str | Column) -> Column:
    """Letters of a range of lines, settled: ``d`` only where a delimiter separates, ``t`` text, ``e`` the first text
    of a story without a title.  ``state`` is one of ``_STATES``.  So ``T`` and ``e`` each tell one story that counts."""
    state = F.lit(state) if isinstance(state, str) else state
    marks = F.regexp_replace(F.concat(state, letters), r"(\Ab*|[Td]b*)d", "$1t")
    return F.substr(F.regexp_replace(marks, r"((?:\A|d)b*)t", "$1e"), F.length(state) + 1)


def _heads_in(marks: Column) -> Column:
    return F.length(F.translate(marks, "bte", ""))


def _found_in(marks: Column) -> Column:
    return F.length(F.translate(marks, "btd", ""))


def split_stories_blocks(lines: DataFrame, keys: list[str], block: str = "block", order: tuple[str, ...] = ("at",),
                         line_col: str = "line") -> DataFrame:
    """``(keys, story_idx, title, paragraphs)`` from the lines of files of any length.

    The same rule as :func:`split_stories`, for files that are read in blocks: a block
    is a range of lines, ``order`` orders lines within it.  Blocks are cut into ranges of
    1,024 numbers of the first column of ``order``, and lines travel once, packed by range
    where they are read.  How a range is cut depends on the state in which it begins: its
    story has neither title nor text yet, a title, or text.  Whether there is text is one
    bit: a text line sets it, a titled delimiter clears it, a bare one turns it over (it
    separates if the bit is set and is text otherwise), a blank line leaves it.  So a range
    maps the bit by its last set or clear and the turns after that.  These maps, and the
    numbers of stories that each state gives, are composed over one thin row for each range.
    Stories inside a range are whole; only the pieces at its ends are moved to meet.
    """
    order = list(order)
    if not {kind for _, kind in lines.select(*order).dtypes} <= {"tinyint", "smallint", "int", "bigint"}:
        lines = lines.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)))
        order = ["__at"]
    at, *rest = [F.coalesce(F.col(c).cast("bigint"), F.lit(-2**63)) for c in order]
    # one struct, so that nulls meet nulls and no branch filters them: all read the same shuffle
    place = F.struct(*keys, block, F.shiftright(at, _RANGE_BITS).alias("__range")).alias("__place")
    # a line is one string, its place in digits of a fixed width before its letter and text: half the bytes of a struct
    line = F.coalesce(F.col(line_col), F.lit(""))
    digits = [F.hex(at.bitwiseAND(2**_RANGE_BITS - 1) + 4096), *[F.lpad(F.hex(c.bitwiseXOR(F.lit(-2**63))), 16, "0") for c in rest]]
    ranges = lines.groupBy(place).agg(F.collect_list(F.concat(*digits, _letter(line), line)).alias("__lines"))
    ranges = _once(ranges, ["__place"], F.transform(
        F.sort_array("__lines"), lambda x: F.substr(x, F.lit(5 + 16 * len(rest)))), "__lines")
    letters = F.array_join(F.transform("__lines", lambda x: F.substring(x, 1, 1)), "")

    # the map of each range without its blank lines, and the state where it begins
    maps = _once(ranges, ["__place"], F.replace(letters, F.lit("b")), "__letters")
    maps = maps.select(
        *[F.col("__place")[c].alias(c) for c in (*keys, block, "__range")],
        F.nullif(F.substring("__letters", -1, 1), F.lit("")).alias("__final"),
        F.nullif(F.regexp_extract("__letters", r"([tT])d*\z", 1), F.lit("")).alias("__set"),
        F.length(F.regexp_extract("__letters", r"(?<!d)d*\z", 0)).alias("__after"),
        F.array(*[F.struct(_heads_in(m).alias("heads"), _found_in(m).alias("found"))
                  for m in (_line_marks(F.col("__letters"), s) for s in _STATES)]).alias("__counts"))
    before = Window.partitionBy(*keys).orderBy(block, "__range").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("__sum", F.coalesce(F.sum("__after").over(before), F.lit(0)))
    there = F.last(F.when(F.col("__set").isNotNull(), F.col("__sum")), ignorenulls=True).over(before)
    bit = (F.coalesce((F.last("__set", ignorenulls=True).over(before) == "t").cast("int"), F.lit(0))
           + F.col("__sum") - F.coalesce(there, F.lit(0)))
    titled = F.last("__final", ignorenulls=True).over(before) == "T"
    maps = maps.withColumn("__state", F.when(bit % 2 == 1, 2).when(titled, 1).otherwise(0))
    counts = F.col("__counts")[F.col("__state")]
    maps = maps.withColumns({"__heads": counts.heads, "__found": counts.found})
    begins = maps.select(F.struct(*keys, block, "__range").alias("__place"), "__state", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__heads", "__found")])

    # places where pieces begin: the start, each delimiter that separates, the end
    work = ranges.join(begins.hint("shuffle_hash"), "__place")
    keep = ["__place", "__lines", "__state", "__heads", "__found"]
    work = _once(work, keep, _line_marks(letters, F.array(*map(F.lit, _STATES))[F.col("__state")]), "__marks")
    kinds, size = F.split("__marks", ""), F.length("__marks")
    cuts = F.filter(F.transform(kinds, lambda k, i: F.when(k.isin("T", "d"), i + 1)), lambda p: p.isNotNull())
    work = _once(work, [*keep, "__marks"], F.struct(kinds.alias("kinds"), F.concat(F.array(F.lit(1)), cuts, F.array(size + 1)).alias("at")), "__c")
    at = F.col("__c.at")

    def rendered(x: Column, kind: Column) -> Column:
        line = F.substr(x, F.lit(2))
        return F.when(kind == "T", _title(line)).when(kind.isin("b", "d"), "").otherwise(line)

    def piece(start: Column, n: Column) -> Column:
        return F.array_join(F.zip_with(F.slice("__lines", start, n), F.slice("__c.kinds", start, n), rendered), "\n")

    def marks(start: Column, n: Column) -> Column:
        return F.substr("__marks", start, n)

    keyed = [F.col("__place")[c].alias(c) for c in keys]
    one, head, tail = F.lit(1), at[1] - 1, F.element_at(at, -2)
    inner = F.transform(F.slice(at, F.lit(2), F.greatest(F.size(at) - 3, F.lit(0))),
                        lambda p, i: F.struct(p.alias("p"), (F.element_at(at, i + 3) - p).alias("n")))
    inner = F.transform(F.filter(inner, lambda s: _found_in(marks(s.p, s.n)) > 0), lambda s: piece(s.p, s.n))
    first = (F.col("__found") + _found_in(marks(one, head))).alias("__first")
    whole = _explode(work, [*keyed, first], inner, "__pos", "__text").select(
        *keys, (F.col("__first") + F.col("__pos")).alias("__idx"), "__text")

    begun, last = F.col("__state") > 0, _found_in(marks(tail, size + 1 - tail))
    ends = F.array(
        F.when(head > 0, F.struct(
            F.lit(False).alias("headed"), F.col("__heads").alias("story"), (F.col("__found") - begun.cast("int")).alias("idx"),
            (begun | (_found_in(marks(one, head)) > 0)).alias("found"), piece(one, head).alias("text"))),
        F.when(F.size(at) > 2, F.struct(
            F.lit(True).alias("headed"), (F.col("__heads") + F.size(at) - 2).alias("story"),
            (F.col("__found") + _found_in(F.col("__marks")) - last).alias("idx"),
            (last > 0).alias("found"), piece(tail, size + 1 - tail).alias("text"))))
    ends = _explode(work, ["__place", *keyed], F.filter(ends, lambda e: e.isNotNull()), "__pos", "__e")
    ends = ends.groupBy(*keys, "__e.story", F.col("__e.idx").alias("__idx")).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col("__place")[c].alias(c) for c in (block, "__range")],
                                             F.col("__e.headed").alias("__headed"), F.col("__e.text").alias("__text")))).alias("__pieces"),
        F.max("__e.found").alias("__counts"))
    # text before the first delimiter has no title line of its own
    text = F.concat(F.when(F.element_at("__pieces", 1)["__headed"], "").otherwise("\n"), F.array_join("__pieces.__text", "\n"))
    stories = whole.union(ends.filter("__counts").select(*keys, "__idx", text.alias("__text")))
    return _once(stories, [*keys, "__idx"], _story(F.col("__text")), "__s").select(
        *keys, F.col("__idx").cast("int").alias("story_idx"), "__s.title", "__s.paragraphs")


def join_scripts(stories: DataFrame, keys: list[str], files: list[str], story_col: str = "story_idx") -> DataFrame:
    """Stories of all scripts of a job, numbered on from script to script.

    ``stories`` are numbered within each script; scripts stand in the order of
    ``files``, which name a script within its job and are dropped.  Only one count
    per script is summed up, so a story's text is not moved for its number.
    """
    sizes = stories.groupBy(*keys, *files).agg(F.count("*").alias("__n"))
    starts = running_before(sizes, keys, [[F.col(c) for c in files]], {"__before": (F.col("__n"), "bigint")}).drop("__n")
    rest = [c for c in stories.columns if c not in (*keys, *files, story_col)]
    return stories.join(starts, [*keys, *files]).select(
        *keys, (F.col(story_col) + F.col("__before")).cast("int").alias(story_col), *rest)


def sentences(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``(keys, sent_idx, text)`` from a clean text."""
    return _explode(df, keys, sentence_list(text_col), "sent_idx", "text")


def split_oversize(df: DataFrame, keys: list[str], col: str = "text",
                   max_words: int = MAX_SENTENCE_WORDS,
                   max_chars: int = MAX_SENTENCE_CHARS) -> DataFrame:
    """``(keys, part_idx, text)``: each sentence cut to the limits; blank runs count as one space."""
    single = F.trim(F.regexp_replace(F.col(col), rf"[{WS}]+", " "))
    parts = split_oversize_list(F.array(single), max_words, max_chars)
    return _explode(df, keys, parts, "part_idx", "text")


def units(stories: DataFrame, keys: list[str], story_col: str = "story_idx",
          paragraphs_col: str = "paragraphs", nfkc_first: bool = True) -> DataFrame:
    """Speech units of stories: ``(keys, story, sent_idx, text, groups, ends_story, n_cards)``.

    Sentences are numbered through all paragraphs of a story.  ``n_cards`` lets
    later steps count cards without reading them.
    """
    paragraphs = nfkc_each(paragraphs_col) if nfkc_first else F.col(paragraphs_col)
    keep = [*keys, story_col]
    rows = stories.select(*keep, paragraphs.alias("__paragraphs"))
    rows = _once(rows, keep, F.flatten(F.transform(
        "__paragraphs", lambda p: sentence_list(tidy_text(p), normalised=True))), "__sentences")
    rows = _once(rows, keep, split_oversize_list("__sentences"), "__units")
    rows = _explode(rows, [*keep, F.size("__units").alias("__n")], F.col("__units"), "sent_idx", "text")
    rows = rows.select(*keep, "sent_idx", "text", caption_cards("text", normalised=True).alias("groups"),
                       (F.col("sent_idx") == F.col("__n") - 1).alias("ends_story"))
    return rows.withColumn("n_cards", F.size("groups"))


def story_words(stories: DataFrame, keys: list[str],
                paragraphs_col: str = "paragraphs") -> DataFrame:
    """Word count per story; sums of it are the count per job."""
    words = F.aggregate(F.transform(paragraphs_col, word_count), F.lit(0), lambda a, n: a + n)
    return stories.select(*keys, words.alias("words"))


def plan_budget(df: DataFrame, target_min, words_col: str = "words",
                wpm: float = WORDS_PER_MINUTE) -> DataFrame:
    """Adds needed words, difference and band for a target length in minutes.

    ``target_min`` is a number or a column.
    """
    return df.withColumns(plan_budget_columns(words_col, target_min, wpm))
