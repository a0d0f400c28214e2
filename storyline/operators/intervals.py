"""Intervals on a job's clock: overlap, snapping, tiling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_MS = 60_000


def boundary_snap(segments: DataFrame, t0: str = "t0_ms", t1: str = "t1_ms") -> DataFrame:
    """Whole-number stamps, so a fractional cut puts each event in one segment."""
    return segments.withColumns({t0: F.ceil(t0).cast("double"), t1: F.floor(t1).cast("double")})


def _buckets(t0: Column, t1: Column, width: int) -> Column:
    first = F.floor(t0 / width)
    last = F.greatest(first, F.ceil(t1 / width) - 1)
    return F.sequence(first.cast("bigint"), last.cast("bigint"))


def overlap_clip(events: DataFrame, segments: DataFrame, keys: Sequence[str],
                 seg_col: str = "idx", bucket_ms: int = BUCKET_MS,
                 on_inverted: str = "fail") -> DataFrame:
    """Events of each segment, clipped to it and stamped from its start.

    Both sides are put into time buckets of their job, and the join is an
    equi-join on job and bucket: one very long job spreads over as many tasks
    as it has buckets, and only events near a segment meet it.  A pair sharing
    several buckets is kept in the first of them only.  A segment gives a row for
    every bucket it touches, which its size before that does not tell, so these rows
    are dealt and never sent whole to every task.  A segment without an end
    is open: it is joined on the job alone and lasts as long as the job has events.

    An event that comes out empty or inverted is an error, or with
    ``on_inverted="keep"`` a row with ``inverted`` true.
    """
    segs = segments.select(*keys, F.col(seg_col).alias("seg_idx"), F.col("t0_ms").cast("double").alias("__s0"),
                           F.col("t1_ms").cast("double").alias("__s1"))
    closed = segs.filter(F.col("__s1") > F.col("__s0")).withColumn(
        "__bucket", F.explode(_buckets(F.col("__s0"), F.col("__s1"), bucket_ms)))
    evs = events.withColumn("__bucket", F.explode(_buckets(F.col("t0_ms"), F.col("t1_ms"), bucket_ms)))
    first_shared = F.floor(F.greatest(F.col("t0_ms"), F.col("__s0")) / bucket_ms)
    pairs = evs.join(closed.hint("merge"), [*keys, "__bucket"]).filter(
        (F.col("t1_ms") > F.col("__s0")) & (F.col("t0_ms") < F.col("__s1"))
        & (F.col("__bucket") == first_shared)).drop("__bucket")
    # a segment without an end takes all later events of its job
    pairs = pairs.unionByName(events.join(segs.filter("__s1 is null"), [*keys]).filter(F.col("t1_ms") > F.col("__s0")))
    start = F.greatest(F.col("t0_ms"), F.col("__s0")) - F.col("__s0")
    stop = F.least(F.col("t1_ms"), F.col("__s1")) - F.col("__s0")      # least() skips a missing end
    rest = [c for c in events.columns if c not in {*keys, "t0_ms", "t1_ms"}]
    out = pairs.select(*keys, "seg_idx", *rest, start.alias("t0_ms"), stop.alias("t1_ms"))
    inverted = F.col("t1_ms") <= F.col("t0_ms")
    if on_inverted == "keep":
        return out.withColumn("inverted", inverted)
    checked = F.when(inverted, F.raise_error(F.lit("inverted event"))).otherwise(F.col("t1_ms"))
    return out.withColumn("t1_ms", checked)


def tiling_check(segments: DataFrame, totals: DataFrame, keys: Sequence[str],
                 tol_ms: float = 0.0, idx: str = "idx") -> DataFrame:
    """Violations of "segments tile 0..total": ``(keys, idx, problem, want, got)``.

    Each cut is compared by grouping the end of segment ``i-1`` and the start of
    segment ``i`` under the key (job, i).  Nothing is ordered, and one long job
    spreads over all tasks.
    """
    none = F.lit(None).cast("double")
    starts = segments.select(*keys, F.col(idx).cast("bigint").alias("idx"),
                             F.col("t0_ms").alias("start"), none.alias("end"))
    ends = segments.select(*keys, (F.col(idx) + 1).cast("bigint").alias("idx"),
                           none.alias("start"), F.col("t1_ms").alias("end"))
    cuts = starts.unionByName(ends).groupBy(*keys, "idx").agg(
        F.max("start").alias("start"), F.max("end").alias("end"))
    first = F.col("idx") == 0
    inner = cuts.filter(F.col("start").isNotNull()).select(
        *keys, "idx",
        F.when(first, "first start is not 0")
        .when(F.col("end").isNull(), "previous segment missing").otherwise("gap or overlap").alias("problem"),
        F.when(first, F.lit(0.0)).otherwise(F.col("end")).alias("want"), F.col("start").alias("got"))
    last = segments.groupBy(*keys).agg(F.max(idx).cast("bigint").alias("idx"), F.max("t1_ms").alias("got"))
    tail = last.join(totals.select(*keys, F.col("total_ms").alias("want")), list(keys)).select(
        *keys, "idx", F.lit("last end is not the total").alias("problem"), "want", "got")
    return inner.unionByName(tail).filter(
        F.col("want").isNull() | (F.abs(F.col("want") - F.col("got")) > tol_ms))
