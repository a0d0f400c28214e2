"""Readers: scripts, provider hits, catalog files, assets, job states, logs."""
from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.running import running_before
from ..operators.catalog import (MAP_TIERS, MAX_HEIGHT, SIZE_CAP, rendition_rank, usable_rendition)

ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
SESSION_MARKER = "---- session ----"

CATALOG_ENTRY = (
    "struct<provider string, id string, duration_s double, width int, height int, "
    "size_bytes bigint, sha256 string, term string, raw string, norm string, norm_duration_s double>")
_SCENES = "array<struct<key string, path string, in_s double, dur_s double>>"
_SEGMENT = ("struct<idx bigint, t0_ms double, t1_ms double, story_first bigint, dur_s double, "
            f"state string, path string, problems array<string>, scenes {_SCENES}>")
_STATE = ("struct<version int, job_id string, params_hash string, "
          f"phases map<string, string>, segments array<{_SEGMENT}>>")


def _whole_files(spark: SparkSession, path) -> DataFrame | None:
    """``(path, updated, value)`` per file, or None where there is no file."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    return rows.select(F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_modification_time").alias("updated"), "value")


def _no_file(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, updated timestamp, value string")


def normalise_newlines(text: Column) -> Column:
    """Drop a byte-order mark; CR, CRLF, VT and FF become newlines."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\x{feff}", ""), r"\r\n?|[\x0b\x0c]", "\n")


def read_scripts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(script_id, path, ord, text)``, one row per file.

    ``ord`` is the place in ``paths`` of the file or folder it came from; order
    files by ``(ord, path)``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.text(p, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.lit(i).alias("ord"), "value") for i, p in enumerate(paths)]
    return reduce(DataFrame.union, parts).select(
        F.sha2("path", 256).alias("script_id"), "path", "ord", normalise_newlines(F.col("value")).alias("text"))


def read_script_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(script_id, path, ord, block, at, sub, line)``: scripts of any length, read in splits by many tasks.

    Lines end as in :func:`read_scripts`; :func:`..operators.split_stories_blocks`
    takes them, ordered by ``at`` and ``sub`` within a block.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.option("lineSep", "\n").text(p).select(
        F.col("_metadata.file_path").alias("path"), F.lit(i).alias("ord"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value") for i, p in enumerate(paths)]
    lines = reduce(DataFrame.union, parts)
    text = F.regexp_replace("value", r"\r\z", "")
    text = F.when(F.col("block") == 0, F.regexp_replace(text, r"\A\x{feff}", "")).otherwise(text)
    return lines.select(F.sha2("path", 256).alias("script_id"), "path", "ord", "block", "at",
                        F.posexplode(F.split(text, r"\r|[\x0b\x0c]")).alias("sub", "line"))


# ---- provider hits ---------------------------------------------------------

_MAP_HIT = ("struct<id string, duration double, tags string, image string, "
            "videos map<string, struct<url string, width int, height int, size string>>>")
_FILE = ("struct<link string, width int, height int, size string, bit_rate string, bitrate string, "
         "duration double>")
_ARRAY_HIT = ("struct<id string, duration string, image string, "
              f"video_files array<{_FILE}>, video_versions array<{_FILE}>>")


def _best(items: Column, allow_unknown: bool, max_h: int, size_cap: int | None) -> Column:
    """Best of an array of ``(tie, url, width, height, size, ...)`` structs."""
    fit = F.filter(items, lambda r: usable_rendition(r.url, r.width, r.height, allow_unknown))
    ranked = F.transform(fit, lambda r: F.struct(
        rendition_rank(r.width, r.height, r.size, r.tie, max_h, size_cap).alias("rank"), r.alias("r")))
    return F.array_min(ranked).r


def _number(c: Column, type: str) -> Column:
    return c.try_cast(type)


def read_provider_hits(df: DataFrame, json_col: str, layout: str, max_h: int = MAX_HEIGHT,
                       size_cap: int | None = SIZE_CAP, provider: str | None = None) -> DataFrame:
    """Clips from a column of provider JSON, one hit per row.

    ``layout`` is "map" (renditions by tier name) or "array" (a list of files).
    Hits without a usable rendition are dropped; all other columns of ``df`` are
    kept, and a ``term`` column among them becomes the clip's term.
    """
    rest = [c for c in df.columns if c not in (json_col, "term")]
    term = F.col("term") if "term" in df.columns else F.lit("")
    if layout == "map":
        hit = F.from_json(F.col(json_col), _MAP_HIT)
        tiers = F.array(*[
            F.struct(F.lit(i).alias("tie"), *[
                F.try_element_at(F.col("__h.videos"), F.lit(t))[f].alias(f)
                for f in ("url", "width", "height", "size")], F.lit(None).cast("bigint").alias("bitrate"))
            for i, t in enumerate(MAP_TIERS)])
        rows = df.select(*rest, term.alias("term"), hit.alias("__h"))
        rows = rows.withColumn("__r", _best(tiers, False, max_h, size_cap))
        duration = F.col("__h.duration")
        rows = rows.filter(F.col("__r").isNotNull() & (F.coalesce(duration, F.lit(0.0)) != 0))
        tags, name = F.coalesce("__h.tags", F.lit("")), provider or "pixabay"
    elif layout == "array":
        hit = F.from_json(F.col(json_col), _ARRAY_HIT)
        rows = df.select(*rest, term.alias("term"), hit.alias("__h"))
        given = F.when(F.size(F.coalesce("__h.video_files", F.array().cast(f"array<{_FILE}>"))) > 0,
                       F.col("__h.video_files")).otherwise(F.col("__h.video_versions"))
        files = F.transform(given, lambda f, i: F.struct(
            i.alias("tie"), f.link.alias("url"), f.width.alias("width"), f.height.alias("height"),
            f["size"].alias("size"),
            F.coalesce(F.nullif(_number(f.bit_rate, "bigint"), F.lit(0).cast("bigint")),
                       _number(f.bitrate, "bigint")).alias("bitrate"),
            f.duration.alias("duration")))
        rows = rows.withColumn("__r", _best(files, True, max_h, size_cap)).filter(F.col("__r").isNotNull())
        duration = F.when(F.col("__h.duration").isNull(), F.col("__r.duration")).otherwise(
            F.col("__h.duration").try_cast("double"))
        tags, name = F.lit(""), provider or "pexels"
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return rows.select(
        *rest, F.lit(name).alias("provider"), F.col("__h.id").alias("id"),
        F.concat(F.lit(name + ":"), F.col("__h.id")).alias("key"),
        F.coalesce(duration.cast("double"), F.lit(0.0)).alias("duration_s"),
        F.coalesce("__r.width", F.lit(0)).alias("width"), F.coalesce("__r.height", F.lit(0)).alias("height"),
        F.col("__r.url").alias("download_url"), F.col("__r.bitrate").alias("bitrate"),
        _number(F.col("__r.size"), "bigint").alias("size_bytes"), tags.alias("tags"),
        "term", F.coalesce("__h.image", F.lit("")).alias("thumb_url"))


# ---- catalog files ---------------------------------------------------------

def parse_catalog(df: DataFrame, json_col: str) -> DataFrame:
    """Keyed rows of map-shaped JSON; what cannot be parsed gives no rows."""
    entries = df.select(F.explode(F.from_json(json_col, f"map<string, {CATALOG_ENTRY}>")).alias("key", "e"))
    return entries.select("key", "e.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog files, each one JSON map; missing or corrupt gives no rows."""
    files = _whole_files(spark, path)
    return parse_catalog(_no_file(spark) if files is None else files, "value")


def parse_blocklist(df: DataFrame, json_col: str) -> DataFrame:
    """``(key, reason)`` from ``{"blocked": {...}}``."""
    blocked = F.from_json(json_col, "struct<blocked map<string, string>>").blocked
    return df.select(F.explode(blocked).alias("key", "reason"))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Blocklist files; missing or corrupt gives no rows."""
    files = _whole_files(spark, path)
    return parse_blocklist(_no_file(spark) if files is None else files, "value")


def read_assets(spark: SparkSession, dirs: Sequence[str],
                exts: Sequence[str] = ASSET_EXTENSIONS) -> DataFrame:
    """``(dir_ord, ext_ord, name, path, size, sha256)``; an empty folder is an error.

    Order assets by ``(dir_ord, ext_ord, name)``.
    """
    found = None
    for i, folder in enumerate(dirs):
        try:
            rows = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(exts))
                    .load(folder))
        except AnalysisException as error:
            raise FileNotFoundError(f"asset folder not found: {folder}") from error
        rows = rows.withColumn("dir_ord", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no asset folder given")
    filled = {r.dir_ord for r in found.select("dir_ord").distinct().collect()}   # at most len(dirs) rows
    empty = [d for i, d in enumerate(dirs) if i not in filled]
    if empty:
        raise ValueError(f"asset folder has no images: {empty[0]}")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return found.select("dir_ord", (F.array_position(F.array(*map(F.lit, exts)), ext) - 1).alias("ext_ord"),
                        name.alias("name"), "path", F.col("length").alias("size"),
                        F.sha2("content", 256).alias("sha256"))


# ---- job files -------------------------------------------------------------

def parse_job_state(jobs: DataFrame, json_col: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``job_phases`` and ``job_segments`` from a column of state JSON."""
    rows = jobs.select(*keys, F.from_json(json_col, _STATE).alias("s")).filter("s is not null")
    phases = rows.select(*keys, F.col("s.params_hash").alias("params_hash"),
                         F.explode("s.phases").alias("phase", "detail"))
    phases = phases.withColumn("done", F.coalesce(
        F.get_json_object("detail", "$.done").try_cast("boolean"), F.lit(False)))
    segments = rows.select(*keys, F.explode("s.segments").alias("g")).select(*keys, "g.*")
    return phases, segments


def read_job_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``job_phases`` and ``job_segments`` of ``path/*/state.json``; bad files are skipped."""
    files = _whole_files(spark, os.path.join(path, "*", "state.json"))
    files = _no_file(spark) if files is None else files
    jobs = files.withColumn("job_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return parse_job_state(jobs, "value", ["job_id", "updated"])


def parse_log_line(line: Column) -> list[Column]:
    pattern = r"(?s)^\[(\d{2}:\d{2}:\d{2})\] (.*)$"
    time = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    message = F.when(time.isNotNull(), F.regexp_extract(line, pattern, 2)).otherwise(line)
    return [time.alias("time"), message.alias("message"), (message == SESSION_MARKER).alias("is_session")]


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``(path, line_no, line)`` of text files of any length, numbered from 0.

    A file is read in splits by many tasks.  A line's number is its place within its
    split plus the lines of the splits before, which are counted where they lie.  A
    line ends with a newline, with or without a carriage return.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    # the lines of a split come in order, and its task numbers them in order
    return running_before(lines, ["path"], [[F.col("__block")], [F.col("__at")]], {"line_no": (F.lit(1), "bigint")}).select(
        "path", "line_no", "line")


def read_log(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """``(path, time, message, is_session)`` of job logs; ``numbered`` adds ``line_no``."""
    try:
        if numbered:
            return numbered_lines(spark, path).select("path", "line_no", *parse_log_line(F.col("line")))
        lines = spark.read.text(path)
    except AnalysisException:
        extra = [F.lit(0).cast("bigint").alias("line_no")] if numbered else []
        return _no_file(spark).select("path", *extra, *parse_log_line(F.col("value")))
    return lines.select(F.col("_metadata.file_path").alias("path"), *parse_log_line(F.col("value")))
