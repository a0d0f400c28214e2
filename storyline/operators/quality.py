"""Quality reports: contracts, conservation, durations, job health."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values (must equal the reference's): the stream contract and tolerances.
GOLDEN_VIDEO = {
    "codec_name": "h264", "profile": "High", "width": 1920, "height": 1080,
    "r_frame_rate": "30/1", "avg_frame_rate": "30/1", "pix_fmt": "yuv420p",
    "sample_aspect_ratio": "1:1", "time_base": "1/30000", "level": 41,
}
GOLDEN_AUDIO = {"codec_name": "aac", "sample_rate": "48000", "channels": 2}
TOLERANCE_S = {"master": 0.02, "render": 0.05, "segment": 0.1, "demote": 0.15,
               "concat": 0.15, "final": 0.25}


def contract_violations(df: DataFrame, expected: Mapping[str, object],
                        ignore: Sequence[str] = (), out: str = "violations") -> DataFrame:
    """Adds the list of ``col=got want x``; a null is a violation."""
    def check(name: str, want) -> Column:
        got = F.col(name)
        text = F.concat(F.lit(f"{name}="), F.coalesce(got.cast("string"), F.lit("null")),
                        F.lit(f" want {want}"))
        return F.when(~got.eqNullSafe(F.lit(want)), text)

    checks = [check(n, w) for n, w in expected.items() if n not in ignore]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn(out, found)


def conservation_check(events: DataFrame, captions: DataFrame, keys: Sequence[str],
                       segments: DataFrame | None = None) -> DataFrame:
    """Jobs where written caption lines and events differ in number.

    Both sides become counters first; one shuffle of one row per job and task.
    With ``segments`` only jobs that have any are checked.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    parts = events.select(*keys, one.alias("e"), zero.alias("c")).unionByName(
        captions.select(*keys, zero.alias("e"), one.alias("c")))
    counts = parts.groupBy(*keys).agg(F.sum("e").alias("events"), F.sum("c").alias("captions"))
    bad = counts.filter(F.col("events") != F.col("captions"))
    if segments is not None:
        bad = bad.join(segments.select(*keys).distinct(), list(keys), "left_semi")
    return bad


def duration_check(df: DataFrame, tol: float, observed: str = "observed_s",
                   planned: str = "planned_s") -> DataFrame:
    """Rows whose observed length is missing or off by more than ``tol``."""
    off = F.abs(F.col(observed) - F.col(planned))
    return df.withColumn("off_s", off).filter(F.col("off_s").isNull() | (F.col("off_s") > tol))


def segment_problems(segments: DataFrame, probes: DataFrame, keys: Sequence[str],
                     tol: float = TOLERANCE_S["segment"]) -> DataFrame:
    """Problems of single segments as ``(keys, scope, problem)``.

    ``segments(keys, idx, state, path, dur_s)``, ``probes(keys, idx, probe_s)``;
    a probe row may carry ``violations`` from :func:`contract_violations`.
    """
    keys = list(keys)
    extra = ["violations"] if "violations" in probes.columns else []
    rows = segments.join(probes.select(*keys, "idx", "probe_s", *extra), [*keys, "idx"], "left")
    done = F.coalesce(F.col("state") == "done", F.lit(False))
    has_file = F.col("path").isNotNull() & (F.col("path") != "")
    off = F.abs(F.col("probe_s") - F.col("dur_s"))
    checks = [
        F.when(~done, F.concat(F.lit("state="), F.coalesce("state", F.lit("null")))),
        F.when(done & ~F.coalesce(has_file, F.lit(False)), F.lit("file missing")),
        F.when(done & has_file & F.col("probe_s").isNull(), F.lit("probe failed")),
        F.when(done & has_file & (off > tol), F.concat(
            F.lit("duration "), F.format_string("%.2f", "probe_s"), F.lit(" vs plan "),
            F.format_string("%.2f", "dur_s")))]
    if extra:
        checks.append(F.when(done & has_file & (F.size("violations") > 0), F.array_join("violations", "; ")))
    return rows.select(*keys, F.concat(F.lit("segment "), F.col("idx").cast("string")).alias("scope"),
                       F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def not_built(jobs: DataFrame, segments: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without any segment or without any caption event, as problem rows."""
    keys = list(keys)
    missing = jobs.select(*keys).join(segments.select(*keys).distinct(), keys, "left_anti").union(
        jobs.select(*keys).join(events.select(*keys).distinct(), keys, "left_anti")).distinct()
    return missing.select(*keys, F.lit("job").alias("scope"), F.lit("not a built job").alias("problem"))


def final_problems(finals: DataFrame, totals: DataFrame, keys: Sequence[str],
                   tol: float = TOLERANCE_S["final"]) -> DataFrame:
    """Problems of finished outputs as ``(keys, scope, problem)``.

    ``finals(keys, path, probe_s)`` has a row for every job that says it is
    finished, with a null ``probe_s`` where no file was found, and may carry
    ``violations``; ``totals(keys, total_ms)``.
    """
    keys = list(keys)
    rows = finals.join(totals.select(*keys, (F.col("total_ms") / 1000.0).alias("__planned")), keys, "left")
    checks = [
        F.when(F.col("probe_s").isNull(), F.concat(F.lit("missing: "), F.coalesce("path", F.lit("null")))),
        F.when(F.abs(F.col("probe_s") - F.col("__planned")) > tol, F.concat(
            F.lit("duration "), F.format_string("%.2f", "probe_s"), F.lit(" vs planned "),
            F.format_string("%.2f", "__planned")))]
    if "violations" in finals.columns:
        checks.append(F.when(F.col("probe_s").isNotNull() & (F.size("violations") > 0), F.array_join("violations", "; ")))
    return rows.select(*keys, F.lit("final").alias("scope"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def job_totals(jobs: DataFrame, segments: DataFrame, events: DataFrame, captions: DataFrame, totals: DataFrame,
               finals: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``(keys, segments_done, segments_planned, events, caption_lines, final, hours)`` for every job.

    All counters are reduced in one shuffle.
    """
    keys = list(keys)
    names = ["segments_done", "segments_planned", "events", "caption_lines"]
    has_file = F.coalesce((F.col("state") == "done") & (F.col("path") != ""), F.lit(False))

    def counted(df: DataFrame, **which) -> DataFrame:
        return df.select(*keys, *[F.coalesce(which[n].cast("bigint"), F.lit(0).cast("bigint")).alias(n) if n in which
                                  else F.lit(0).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    counts = (counted(segments, segments_done=has_file, segments_planned=one)
              .union(counted(events, events=one)).union(counted(captions, caption_lines=one))
              .groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]))
    out = jobs.select(*keys).join(counts, keys, "left").join(
        totals.select(*keys, F.round(F.col("total_ms") / 3_600_000.0, 3).alias("hours")), keys, "left")
    if finals is None:
        out = out.withColumn("final", F.lit(None).cast("string"))
    else:
        out = out.join(finals.select(*keys, F.col("path").alias("final")), keys, "left")
    return out.select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "final", "hours")


def job_problems(*problem_dfs: DataFrame) -> DataFrame:
    """All problem rows, one per problem; nothing is gathered per job."""
    out = problem_dfs[0]
    for df in problem_dfs[1:]:
        out = out.unionByName(df)
    return out


def job_report(jobs: DataFrame, problems: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, ok, n_problems, first_problem)`` for every job.

    The problems themselves stay rows of ``job_problems``: a job can have any
    number of them, so they are not put into one array.
    """
    text = F.concat_ws(": ", "scope", "problem")
    found = problems.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("first_problem"))
    n = F.coalesce("n", F.lit(0))
    return jobs.select(*keys).join(found, list(keys), "left").select(
        *keys, (n == 0).alias("ok"), n.alias("n_problems"), "first_problem")
