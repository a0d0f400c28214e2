"""Classifying clips from content boxes sampled at a few times."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values (must equal the reference's).
FULL_MIN_W, FULL_MIN_H = 1900, 1069
SAMPLE_SHARES = (0.1, 0.3, 0.5, 0.7, 0.9)
MIN_CLIP_S = 3.0
TAIL_S = 1.5
MAX_TRIM_SHARE = 0.75


def is_full(w="w", h="h", min_w: int = FULL_MIN_W, min_h: int = FULL_MIN_H) -> Column:
    return (F.col(w) >= min_w) & (F.col(h) >= min_h)


def sample_times(dur: Column) -> Column:
    """The five sampling times of a clip."""
    return F.array(*[F.least(dur - 1.0, dur * share) for share in SAMPLE_SHARES])


def shape_classify(samples: DataFrame, clips: DataFrame, key: str,
                   full: Column | None = None) -> DataFrame:
    """``(key, kind, w, h, x, y, trim_s)`` with kind none, static or dynamic.

    ``samples(key, slot, w, h, x, y)`` has one row per sampled time (slot 0..4;
    null ``w`` means the probe found nothing) and ``clips(key, dur_s, trim_s)``
    the length and the start of the clean tail, if any.  Every test is a minimum
    or maximum, so samples are reduced before the shuffle.
    """
    known = samples.filter(F.col("w").isNotNull())
    f = (is_full() if full is None else full).cast("int")
    box = ("w", "h", "x", "y")
    facts = known.groupBy(key).agg(
        F.count_if(F.col("slot").between(0, 4)).alias("__n"),
        F.min(f).alias("__all"), F.max(f).alias("__any"),
        F.max(F.when(F.col("slot") == 0, f)).alias("__first"),
        F.min(F.when(F.col("slot") >= 3, f)).alias("__end"),
        *[F.min(c).alias(c) for c in box], *[F.max(c).alias(f"__max_{c}") for c in box])
    same = F.lit(True)
    for c in box:
        same = same & (F.col(c) == F.col(f"__max_{c}"))
    judged = clips.select(key, "dur_s", F.col("trim_s").alias("__trim")).join(facts, key, "left")
    enough = (F.col("dur_s") >= MIN_CLIP_S) & (F.col("__n") == 5)
    static = enough & (F.col("__any") == 0) & same
    dynamic = (enough & (F.col("__any") == 1) & (F.col("__first") == 0) & (F.col("__end") == 1)
               & F.col("__trim").isNotNull() & (F.col("__trim") <= F.col("dur_s") * MAX_TRIM_SHARE))
    return judged.select(
        key, F.when(static, "static").when(dynamic, "dynamic").otherwise("none").alias("kind"),
        *[F.when(static, F.col(c)).alias(c) for c in box],
        F.when(dynamic, F.col("__trim")).otherwise(F.lit(0.0)).alias("trim_s"))


def clean_suffix_start(samples: DataFrame, clips: DataFrame, key: str,
                       full: Column | None = None, tail_s: float = TAIL_S) -> DataFrame:
    """``(key, trim_s)``: earliest sampled time from which all samples are full.

    The last ``tail_s`` seconds must hold a sample and all of them be full.  Two
    hash aggregations: the last sample that is not full, and the first after it.
    """
    f = is_full() if full is None else full
    # one row per clip on the other side of both joins
    rows = samples.join(clips.select(key, "dur_s"), key).select(
        key, F.col("t").cast("double").alias("t"), f.alias("f"), (F.col("t") >= F.col("dur_s") - tail_s).alias("tail"))
    ends = rows.groupBy(key).agg(
        F.max(F.when(~F.col("f"), F.col("t"))).alias("bad"), F.max(F.col("tail").cast("int")).alias("tail"),
        F.min(F.when(F.col("tail"), F.col("f").cast("int"))).alias("tail_ok"))
    good = ends.filter((F.col("tail") == 1) & (F.col("tail_ok") == 1)).select(key, "bad")
    start = rows.join(good, key).filter(F.col("bad").isNull() | (F.col("t") > F.col("bad"))).groupBy(key).agg(
        F.min("t").alias("trim_s"))
    return clips.select(key).join(start, key, "left").select(key, "trim_s")
