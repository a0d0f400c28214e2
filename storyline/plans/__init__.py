"""End-to-end jobs: build a plan from scripts, grow a catalog, verify a job."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import content_key
from ..operators import (assign_round_robin, boundary_snap, budget_prefix, cached_enrich,
                         card_events, conservation_check, final_problems, first_seen_dedupe, fresh_candidates,
                         job_problems, job_report, job_summary, job_totals, join_scripts, not_built, overlap_clip, plan_scenes, plan_segments,
                         pool_coverage, segment_problems, split_stories,
                         timeline_chunks, units)
from ..session import cut_lineage
from ..sources import read_scripts, write_timeline


@dataclass
class Timeline:
    stories: DataFrame
    chunks: DataFrame
    events: DataFrame
    summary: DataFrame
    keys: list[str] = field(default_factory=lambda: ["script_id"])


def read_jobs(spark: SparkSession, jobs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Scripts of jobs (job_id, ord, path, text); a job has its scripts in the order of ``jobs[job_id]``."""
    return reduce(DataFrame.union, [
        read_scripts(spark, paths).select(F.lit(job).alias("job_id"), "ord", "path", "text") for job, paths in jobs.items()])


def job_stories(scripts: DataFrame) -> DataFrame:
    """Stories of (job_id, ord, path, text), numbered through all scripts of a job.

    A script without any story is an error; its name is looked up at once.  Stories
    are written once, as the look-up, the counts and the result all read them.
    """
    names = ["job_id", "ord", "path"]
    stories = cut_lineage(split_stories(scripts, names))
    bare = scripts.select(*names).join(stories.select(*names).distinct(), names, "left_anti").limit(5).collect()
    if bare:
        raise ValueError("no stories found in " + ", ".join(r["path"] for r in bare))
    return join_scripts(stories, ["job_id"], ["ord", "path"])


def build_timeline(spark: SparkSession, paths: str | Sequence[str] | Mapping[str, Sequence[str]], synthesise: Callable,
                   cache_path: str, out_path: str, voice: str, speed: float = 1.0,
                   concurrency: int | None = None) -> Timeline:
    """Scripts to stored chunks and events.

    With a list of paths each script is a job, named by ``script_id``.  A mapping
    names jobs (``job_id``) and gives each its scripts in order; their stories
    follow each other on one clock.

    ``synthesise(batch)`` gets ``sha`` and ``text`` and returns ``sha`` and
    ``nbytes``.  Units, chunks and events are stored as they are made, so the text
    work and the joins each run once.
    """
    if isinstance(paths, Mapping):
        keys, stories = ["job_id"], job_stories(read_jobs(spark, paths))
    else:
        keys, stories = ["script_id"], split_stories(read_scripts(spark, paths), ["script_id"])
    rows = units(stories, keys)
    rows = rows.withColumn("sha", content_key("text", F.lit(voice), F.lit(speed)))
    rows = cached_enrich(rows, "sha", synthesise, "nbytes bigint", cache_path,
                         ord=[*keys, "story_idx", "sent_idx"], concurrency=concurrency, inputs=["text"])
    rows.write.mode("overwrite").parquet(f"{out_path}/units")
    chunks = timeline_chunks(spark.read.parquet(f"{out_path}/units"), keys)
    chunks, events = write_timeline(chunks, lambda stored: card_events(stored, keys), out_path)
    return Timeline(stories, chunks, events, job_summary(chunks, events, keys), keys)


def build_plan(timeline: Timeline, pool: DataFrame, seg_max_s: float, keys: Sequence[str] | None = None,
               seed: int = 1234, poses: Sequence[str] = ()) -> DataFrame:
    """Segments with scenes and a pose; ``timeline`` must be stored."""
    keys = list(keys or timeline.keys)
    segments = plan_segments(timeline.events, timeline.summary, keys, seg_max_s, stage=False)
    segments = segments.withColumn("dur_s", (F.col("t1_ms") - F.col("t0_ms")) / 1000.0)
    return assign_round_robin(plan_scenes(segments, pool, keys, seed), "story_first", poses, "pose")


def segment_captions(timeline: Timeline, segments: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Events of every segment, each event in exactly one."""
    return overlap_clip(timeline.events, boundary_snap(segments), list(keys or timeline.keys))


def top_up(hits: DataFrame, catalog: DataFrame, blocklist: DataFrame, pool: DataFrame,
           needed: DataFrame, keys: Sequence[str], ord: Sequence[str]) -> DataFrame:
    """Hits to fetch so that the pool covers its need: one plan, no rounds."""
    fresh = fresh_candidates(first_seen_dedupe(hits, "key", ord), catalog, blocklist)
    cover = pool_coverage(pool, needed, keys)
    need = cover.filter(~F.col("enough")).select(
        *keys, (F.col("needed_s") * 1.2 - F.col("cover_s")).alias("need_s"))
    return budget_prefix(fresh, need, keys, ord=ord)


def verify(segments: DataFrame, probes: DataFrame, events: DataFrame, captions: DataFrame,
           keys: Sequence[str], jobs: DataFrame | None = None, totals: DataFrame | None = None,
           finals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Report per job, and all its problems.

    With ``jobs`` those without segments or events are reported too; with
    ``totals(keys, total_ms)`` the report has the counters of a job, and
    ``finals(keys, path, probe_s)`` of finished jobs are held against them.
    """
    keys = list(keys)
    everyone = (segments if jobs is None else jobs).select(*keys).distinct()
    lost = conservation_check(events, captions, keys, segments).select(
        *keys, F.lit("captions").alias("scope"),
        F.concat(F.col("captions").cast("string"), F.lit(" lines for "),
                 F.col("events").cast("string"), F.lit(" events")).alias("problem"))
    found = [segment_problems(segments, probes, keys), lost]
    if jobs is not None:
        found.append(not_built(everyone, segments, events, keys))
    if finals is not None and totals is not None:
        found.append(final_problems(finals, totals, keys))
    problems = job_problems(*found)
    report = job_report(everyone, problems, keys)
    if totals is not None:
        report = report.join(job_totals(everyone, segments, events, captions, totals, finals, keys), keys)
    return report, problems
