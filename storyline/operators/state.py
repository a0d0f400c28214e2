"""Job state: counts, progress, board, resume."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PENDING = "pending"


def status_counts(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per state; a missing state counts as pending."""
    return segments.groupBy(*keys, F.coalesce("state", F.lit(PENDING)).alias("state")).agg(
        F.count(F.lit(1)).alias("n"))


def progress(phases: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per job: done phases, segments total, counts by state, progress in 0..1.

    Segments are reduced to one row per (job, state) before anything is put in
    a map, so the map only ever holds the few states there are.
    """
    keys = list(keys)
    counts = status_counts(segments, keys).groupBy(*keys).agg(
        F.sum("n").alias("segments_total"),
        F.sum(F.when(F.col("state") == "done", F.col("n")).otherwise(0)).alias("__done"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("segments"))
    done = phases.groupBy(*keys).agg(F.array_sort(F.collect_set(
        F.when(F.coalesce("done", F.lit(False)), F.col("phase")))).alias("phases_done"))
    both = done.join(counts, keys, "full")
    finished = F.coalesce(F.array_contains("phases_done", "concat"), F.lit(False))
    share = (F.when(finished, F.lit(1.0))
             .when(F.coalesce("segments_total", F.lit(0)) > 0, F.col("__done") / F.col("segments_total"))
             .otherwise(F.lit(0.0)))
    return both.select(
        *keys, F.coalesce("phases_done", F.array().cast("array<string>")).alias("phases_done"),
        F.coalesce("segments_total", F.lit(0)).alias("segments_total"),
        F.coalesce("segments", F.create_map().cast("map<string,bigint>")).alias("segments"),
        F.bround(share, 4).alias("progress"))


def job_board(progress_df: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Progress with output size, the newest job first.

    ``outputs(keys, updated, size)``: ``size`` is null without an output file.
    """
    return progress_df.join(outputs, list(keys), "left").orderBy(
        F.desc_nulls_last("updated"), *keys)


def resume_filter(work: DataFrame, done: DataFrame, params: str | None, keys: Sequence[str],
                  hash_col: str = "params_hash") -> DataFrame:
    """Work rows without a finished output.

    ``done(keys, state, output, params_hash)``.  A stored hash that differs from
    ``params`` is refused when the rows are read.
    """
    if params is not None:
        wrong = F.raise_error(F.lit("job was built with different parameters"))
        same = F.when(F.col(hash_col).eqNullSafe(F.lit(params)), F.lit(True)).otherwise(wrong.cast("boolean"))
        done = done.filter(same)
    finished = done.filter((F.col("state") == "done") & F.col("output").isNotNull())
    return work.join(finished.select(*keys), list(keys), "left_anti")
