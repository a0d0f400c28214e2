"""Filling segments with clips: one walk over thin rows, everything else in columns."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .running import running_before

# Fixed values (must equal the reference's).
SCENE_MIN_S, SCENE_MAX_S = 8.0, 16.0
SCENE_STUB_S = 0.05
RECENT_WINDOW = 6
POOL_MIN = RECENT_WINDOW + 2

_MIN_MS, _MAX_MS, _STUB_MS = (int(s * 1000) for s in (SCENE_MIN_S, SCENE_MAX_S, SCENE_STUB_S))
_UNKNOWN_MS = 1 << 40      # a clip without a length is as long as needed
_CHUNK = 1 << 16
# The largest primes below 2**31: each is coprime to the size of any group of clips.
MULTIPLIERS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497,
               2147483489, 2147483477, 2147483423, 2147483399, 2147483353, 2147483323, 2147483269, 2147483249)


def _draw(*parts: Column) -> Column:
    """A whole number below 2**32 from a hash of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint")


def _drawn(text: str) -> int:
    """The same number for a text in Python."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


class _Laps:
    """The picks of one job: laps through all clips, each in an order of its own.

    The clips stand in groups, and a lap goes through one group after another, so a
    clip comes back after at least as many picks as lie outside its group: never
    within seven, also where two laps meet.  Inside a group the order of a lap is
    ``place * a + b`` modulo the size of the group, a and b being drawn.
    """

    def __init__(self, caps: np.ndarray, seed: int, job: str):
        self.caps, self.name, self.size = caps, f"{seed}|{job}", len(caps)
        self.groups = 1 if self.size < POOL_MIN else -(-self.size // (self.size - RECENT_WINDOW))

    def scenes(self, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths in ms of ``count`` scenes from number ``n`` on."""
        numbers = np.arange(n, n + count)
        q = numbers % self.size
        group = ((q + 1) * self.groups - 1) // self.size
        low = group * self.size // self.groups
        wide = (group + 1) * self.size // self.groups - low
        order = (numbers // self.size) * self.groups + group
        kinds, which = np.unique(order, return_inverse=True)
        drawn = np.array([_drawn(f"{self.name}|{k // self.groups}|{k % self.groups}|order") for k in kinds.tolist()])[which]
        place = low + ((q - low) * np.array(MULTIPLIERS)[drawn % 16] + drawn // 16) % wide
        lasts = np.array([_MIN_MS + _drawn(f"{self.name}|{i}") % (_MAX_MS - _MIN_MS + 1) for i in numbers.tolist()])
        return place, np.minimum(lasts, self.caps[place])

    def fill(self, n: int, ms: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the scenes that fill ``ms``, from number ``n`` on."""
        places, lengths, filled = [], [], 0.0
        while ms - filled >= _STUB_MS:
            place, length = self.scenes(n, min(4096, int((ms - filled) / _MIN_MS) + 2))
            ends = filled + np.cumsum(length)
            used = min(int(np.count_nonzero(ms - ends >= _STUB_MS)) + 1, len(ends))
            places.append(place[:used])
            lengths.append(length[:used].astype(float))
            n, filled = n + used, float(ends[used - 1])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        lengths = np.concatenate(lengths)
        lengths[-1] += ms - filled     # the last scene ends with the segment
        return np.concatenate(places), lengths


def _walk(keys: list[str], seed: int):
    """Scenes of segments that come in order of their jobs, after the lengths of the clips."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[np.ndarray] = []
        laps, current, n, share = None, None, 0, None
        for batch in batches:
            caps, part = batch.column("__caps"), batch.column("__part").to_pylist()
            own = [batch.column(k) for k in keys]
            jobs, ms = batch.column("__job").to_pylist(), batch.column("__ms").to_pylist()
            names = list(zip(part, *[c.to_pylist() for c in own]))
            rows, places, lengths, ks = [], [], [], []
            for i, name in enumerate(names):
                if name[0] != share:     # another share of the jobs, with its own copy of the lengths
                    chunks, current, share = [], None, name[0]
                if caps[i].is_valid:
                    chunks.append(caps[i].values.to_numpy())
                    continue
                if name != current:
                    laps, current, n = _Laps(np.concatenate(chunks), seed, jobs[i]), name, 0
                place, length = laps.fill(n, ms[i])
                n += len(place)
                rows.append(np.full(len(place), i))
                ks.append(np.arange(len(place)))
                places.append(place)
                lengths.append(length)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(at) for c in own], batch.column("idx").take(at), pa.array(np.concatenate(ks)),
                     pa.array(np.concatenate(places)), pa.array(np.concatenate(lengths))],
                    names=[*keys, "idx", "__k", "__place", "__dur"])
    return walk


def plan_scenes(segments: DataFrame, pool: DataFrame, keys: Sequence[str], seed: int = 1234) -> DataFrame:
    """Fill each segment with clips; adds ``scenes`` to the segment rows.

    *Lengths.*  A scene lasts 8 to 16 s by a draw of its own, less where its clip is
    shorter or the segment ends.  What is left of a segment below 0.05 s is added to
    its last scene; a segment shorter than that has no scene.

    *Clips.*  A job takes every clip of the pool once, then all again in another
    order, and so on; segments go on where the one before ended.  No clip comes back
    within seven picks, unless the pool has fewer than eight.  A clip that leaves
    more than a second is entered at a drawn place.

    Where a scene begins depends on the lengths of all clips before it, so a job is
    walked from its first segment to its last.  The walk streams over one thin row
    per segment and keeps nothing but its place; beside it a task holds two bytes
    per clip.  Keys, paths and places to enter are joined to its result.

    The rule is the same for every size of pool and job, and what a segment gets
    does not depend on later ones.  A clip key that occurs twice counts with its
    least path.  A clip without a length, or with less than 0.05 s, is as long as
    needed.  A pool without any clip is an error; whether there is one is looked up first.
    """
    keys = list(keys)
    spark = segments.sparkSession
    length = F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0))
    usable = pool.filter(F.col("path").isNotNull() & (F.col("path") != ""))
    if usable.isEmpty():
        raise ValueError("empty clip pool: nothing to plan scenes from")
    clips = (usable
             .select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("path").cast("string").alias("path"),
                     F.when(length >= SCENE_STUB_S, F.floor(length * 1000)).otherwise(_UNKNOWN_MS).alias("ms"))
             .groupBy("key").agg(F.min(F.struct("path", "ms")).alias("c")).select("key", "c.path", "c.ms"))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "key"), 256)
    placed = running_before(
        clips.withColumn("__one", F.shiftright("ms", 62)), ["__one"], [[F.substring(order, 1, 3)], [order, F.col("key")]],
        {"__place": (F.lit(1), "bigint")}).select("__place", "key", "path", "ms")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    job = [F.col(k) for k in keys]
    thin = segments.select(
        F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("__part"), F.lit(None).cast("int").alias("__chunk"),
        F.lit(None).cast("array<int>").alias("__caps"), F.concat_ws("|", *[c.cast("string") for c in job]).alias("__job"), *keys, "idx",
        (F.col("t1_ms").cast("double") - F.col("t0_ms").cast("double")).alias("__ms"))
    # every share of the jobs gets the lengths of the clips first
    chunks = (placed.select(F.floor(F.col("__place") / _CHUNK).cast("int").alias("__chunk"), "__place",
                            F.least(F.col("ms"), F.lit(_MAX_MS)).cast("int").alias("cap"))
              .groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("__place", "cap"))).alias("c")))
    heads = chunks.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"), "__chunk", F.col("c.cap").alias("__caps"),
        *[F.lit(None).cast(thin.schema[c].dataType).alias(c) for c in ("__job", *keys, "idx", "__ms")])
    schema = T.StructType([*[thin.schema[c] for c in (*keys, "idx")], *[T.StructField(c, t) for c, t in (
        ("__k", T.LongType()), ("__place", T.LongType()), ("__dur", T.DoubleType()))]])
    slots = (heads.unionByName(thin).repartition(parts, "__part")
             .sortWithinPartitions("__part", F.col("__chunk").asc_nulls_last(), *keys, "idx")
             .mapInArrow(_walk(keys, seed), schema))
    spare = F.col("ms") - F.ceil("__dur")
    enter = F.when((F.col("ms") < _UNKNOWN_MS) & (spare > 1000),
                   F.pmod(_draw(F.lit(seed), *job, F.col("idx"), F.col("__k"), F.lit("in")), spare + 1)).otherwise(0)
    scene = F.struct(F.col("__k"), F.col("key"), F.col("path"), (enter / 1000.0).alias("in_s"),
                     F.round(F.col("__dur") / 1000.0, 3).alias("dur_s"))
    filled = slots.join(placed, "__place").groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(scene)).alias("__s"))
    scenes = F.transform("__s", lambda s: F.struct(s["key"].alias("key"), s["path"].alias("path"),
                                                   s["in_s"].alias("in_s"), s["dur_s"].alias("dur_s")))
    return segments.join(filled.select(*keys, "idx", scenes.alias("scenes")), [*keys, "idx"], "left").select(
        *segments.columns, F.coalesce("scenes", F.array().cast(
            "array<struct<key:string,path:string,in_s:double,dur_s:double>>")).alias("scenes"))
