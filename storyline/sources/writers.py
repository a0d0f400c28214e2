"""Writers: captions of segments, timeline tables."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.scalars import escape_caption, stamp_cs
from .folders import write_text_folders
from .packs import PACK_FILES, write_text_packs

# A caption file starts with this; ``title`` is filled in.
CAPTION_HEADER = (
    "[Script Info]\n"
    "Title: {title}\n"
    "ScriptType: v4.00+\n"
    "PlayResX: 1920\n"
    "PlayResY: 1080\n"
    "\n"
    "[Events]\n"
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text")


def dialogue_line(effect: str = "", style: str = "Narr"):
    """One caption line from ``t0_ms``, ``t1_ms`` and ``text``."""
    return F.concat(F.lit("Dialogue: 0,"), stamp_cs("t0_ms"), F.lit(","), stamp_cs("t1_ms"),
                    F.lit(f",{style},,0,0,0,,{effect}"), escape_caption("text"))


def _caption_lines(df: DataFrame, group: list[str], header: str, title: str, effect: str,
                   segments: DataFrame | None) -> tuple[DataFrame, Observation]:
    """(group, __o, __id, value): a head and the dialogue of every segment, and a count of the dialogue."""
    seen = Observation()
    lines = df.select(*group, F.lit(1).alias("__o"), F.col("id").cast("bigint").alias("__id"),
                      dialogue_line(effect).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    named = (df.select(*group).distinct() if segments is None
             else segments.select(*group[:-1], F.col("idx").alias(group[-1])))
    heads = named.select(
        *group, F.lit(0).alias("__o"), F.lit(-1).cast("bigint").alias("__id"),
        F.lit(header.replace("{title}", title.replace("\n", " "))).alias("value"))
    return lines.unionByName(heads), seen


def write_captions(df: DataFrame, path: str, header: str = CAPTION_HEADER, title: str = "captions",
                   keys: Sequence[str] = ("job_id",), seg_col: str = "seg_idx", effect: str = "",
                   partitions: int | None = None, segments: DataFrame | None = None) -> int:
    """One text file per (job, segment); returns the number of dialogue lines.

    ``df`` holds events already clipped to their segment.  With ``segments(keys,
    idx)`` a segment without events gets a file too, and ``df`` is read once.  All lines of a file
    meet in one task by (job, segment), so a long job spreads over its segments.
    Every segment is a folder that its task writes; :func:`.folders.read_text_folders` reads
    them without listing them.  :func:`write_caption_packs` is for very many of them.
    """
    group = [*keys, seg_col]
    both, seen = _caption_lines(df, group, header, title, effect, segments)
    write_text_folders(both, path, group, ["__o", "__id"], partitions)
    return int(seen.get["n"])


def write_caption_packs(df: DataFrame, path: str, header: str = CAPTION_HEADER, title: str = "captions",
                        keys: Sequence[str] = ("job_id",), seg_col: str = "seg_idx", effect: str = "",
                        partitions: int | None = None, segments: DataFrame | None = None, files: int = PACK_FILES) -> int:
    """The same texts, those of up to ``files`` segments in one file; returns the number of dialogue lines.

    :func:`.packs.read_texts` gives them back, all or those of an index.
    """
    group = [*keys, seg_col]
    both, seen = _caption_lines(df, group, header, title, effect, segments)
    write_text_packs(both, path, group, ["__o", "__id"], files, partitions)
    return int(seen.get["n"])


def write_timeline(chunks: DataFrame, events: DataFrame | Callable[[DataFrame], DataFrame],
                   path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and events as parquet; returns the stored tables.

    ``events`` may be a function of the stored chunks, so that these are not
    worked out a second time.  Both tables are written beside an existing timeline at
    ``path`` and take its place when they are whole; a run that fails leaves it as it
    was.
    """
    spark = chunks.sparkSession
    stage = os.path.join(path, f"_stage-{uuid.uuid4().hex}")
    chunks.write.parquet(os.path.join(stage, "chunks"))
    rows = events(spark.read.parquet(os.path.join(stage, "chunks"))) if callable(events) else events
    rows.write.parquet(os.path.join(stage, "events"))
    names = spark._jvm.org.apache.hadoop.fs.Path
    system = names(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("chunks", "events"):
        target = names(os.path.join(path, name))
        system.delete(target, True)
        system.rename(names(os.path.join(stage, name)), target)
    system.delete(names(stage), True)
    return tuple(spark.read.parquet(os.path.join(path, name)) for name in ("chunks", "events"))
