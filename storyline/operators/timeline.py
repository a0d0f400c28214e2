"""The byte clock: units to timed chunks, caption events and job totals.

All sums are whole bytes (48 per millisecond), so they do not depend on the
partitioning; milliseconds come from one division at the end.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import BYTES_PER_MS, bytes_to_ms, hms
from ..functions.text import word_count
from .running import blocks_of, running_before

# Fixed values in milliseconds (must equal the reference's).
PREROLL_MS = 800
SILENCE_SENTENCE_MS = 200
SILENCE_STORY_MS = 1200
CARD_FLOOR_MS = 900

# One block of stories is one sort group.  A story comes from one text row, so
# the number of its units is bounded; the number of stories in a job is not.
STORY_BLOCKS = (65_536, 64)


def timeline_chunks(units: DataFrame, keys: Sequence[str],
                    ord: Sequence[str] = ("story_idx", "sent_idx"),
                    nbytes_col: str = "nbytes") -> DataFrame:
    """Place every unit on its job's clock.

    Adds ``i`` (position in the job), ``silence_after_ms``, ``t0_bytes``,
    ``dur_ms``, ``t0_ms``, ``t1_ms`` and ``first_event`` (number of caption
    cards before the unit).
    """
    story, sent = (F.col(c) for c in ord)
    silence_ms = F.when(F.col("ends_story"), SILENCE_STORY_MS).otherwise(SILENCE_SENTENCE_MS)
    rows = units.withColumn("silence_after_ms", silence_ms)
    nbytes = F.col(nbytes_col).cast("bigint")
    placed = running_before(
        rows, keys,
        [*blocks_of(story, *STORY_BLOCKS), [story, sent]],
        {"__t": (nbytes + F.col("silence_after_ms") * BYTES_PER_MS, "bigint"),
         "first_event": (F.col("n_cards") if "n_cards" in units.columns else F.size("groups"), "bigint"),
         "i": (F.lit(1), "bigint")})
    t0 = F.col("__t") + PREROLL_MS * BYTES_PER_MS
    return placed.select(
        *units.columns, "silence_after_ms", "i", "first_event", t0.alias("t0_bytes"),
        bytes_to_ms(nbytes).alias("dur_ms"), bytes_to_ms(t0).alias("t0_ms"),
        bytes_to_ms(t0 + nbytes).alias("t1_ms"))


def card_events(chunks: DataFrame, keys: Sequence[str],
                story_col: str = "story_idx", nbytes_col: str = "nbytes") -> DataFrame:
    """One row per caption card.

    A unit's time is split over its cards: a floor for each, the rest by card
    length.  The boundary after ``k`` cards has a closed form over the prefix
    of card lengths, so no running state is needed and nothing is shuffled.
    """
    nbytes = F.col(nbytes_col).cast("bigint")
    cards = F.size("groups")
    lengths = F.transform("groups", F.length)
    prefix = F.aggregate(
        lengths, F.array(F.lit(0)),
        lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    floor_bytes = F.least(F.lit(CARD_FLOOR_MS), F.expr(
        f"`{nbytes_col}` div ({BYTES_PER_MS} * size(groups))")).cast("bigint") * BYTES_PER_MS
    rows = chunks.filter(cards > 0).select(
        *keys, F.col(story_col).alias("story"), F.col("i").alias("sentence"),
        "ends_story", "first_event", "t0_bytes", nbytes.alias("__n"), cards.alias("__g"),
        floor_bytes.alias("__floor"), prefix.alias("__prefix"),
        F.posexplode("groups").alias("grp", "text"))
    total = F.element_at("__prefix", F.col("__g") + 1).cast("bigint")
    spare = F.col("__n") - F.col("__floor") * F.col("__g")

    def boundary(k: Column) -> Column:
        done = F.element_at("__prefix", k + 1).cast("bigint")
        exact = ((F.col("t0_bytes") + F.col("__floor") * k) * total + spare * done)
        return exact / (total * BYTES_PER_MS)

    start = F.col("t0_bytes") / F.lit(BYTES_PER_MS)
    end = (F.col("t0_bytes") + F.col("__n")) / F.lit(BYTES_PER_MS)
    last = F.col("grp") == F.col("__g") - 1
    return rows.select(
        *keys, (F.col("first_event") + F.col("grp")).alias("id"), "story", "sentence", "grp", "text",
        F.when(F.col("grp") == 0, start).otherwise(boundary(F.col("grp"))).alias("t0_ms"),
        F.when(last, end).otherwise(boundary(F.col("grp") + 1)).alias("t1_ms"),
        (F.col("ends_story") & last).alias("story_end"))


def job_summary(chunks: DataFrame, events: DataFrame, keys: Sequence[str],
                nbytes_col: str = "nbytes", words: DataFrame | None = None) -> DataFrame:
    """Length (trailing silence included), words, sentences and events per job.

    Both inputs are reduced to counters before the one shuffle.  ``words`` may
    give the words of the stories (column ``words``); without it the words of
    the units are counted.
    """
    zero = F.lit(0).cast("bigint")
    end = (F.col("t0_bytes") + F.col(nbytes_col) + F.col("silence_after_ms") * BYTES_PER_MS).cast("bigint")
    unit_words = word_count("text").cast("bigint") if words is None else zero
    parts = chunks.select(*keys, end.alias("e"), unit_words.alias("w"),
                          F.lit(1).cast("bigint").alias("s"), zero.alias("c"))
    parts = parts.unionByName(events.select(
        *keys, zero.alias("e"), zero.alias("w"), zero.alias("s"), F.lit(1).cast("bigint").alias("c")))
    if words is not None:
        parts = parts.unionByName(words.select(
            *keys, zero.alias("e"), F.col("words").cast("bigint").alias("w"), zero.alias("s"), zero.alias("c")))
    total = parts.groupBy(*keys).agg(F.max("e").alias("e"), F.sum("w").alias("words"),
                                     F.sum("s").alias("sentences"), F.sum("c").alias("caption_events"))
    ms = bytes_to_ms("e")
    return total.select(*keys, ms.alias("total_ms"), "words", "sentences", "caption_events",
                        hms(ms).alias("length"))
