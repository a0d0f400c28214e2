"""Cutting a job's clock into bounded segments, and one resource for each."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

# Fixed values (must equal the reference's).
TAIL_MS = 1.0

BLOCK_SPAN = 1024           # longest segments per time block of plan_segments
BLOCK_FAN = 1024            # blocks per group, and groups per group of groups
_LEVELS = 2


def _table(keys: list[str], key: tuple, columns: dict[str, tuple]) -> pa.Table:
    """Arrow rows of one group, with its key in front."""
    n = len(next(iter(columns.values()))[1])
    return pa.table({**{k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)},
                     **{c: pa.array(values, kind) for c, (kind, values) in columns.items()}})


# ---- plan_segments ---------------------------------------------------------

class _Block:
    """States of one time block: "everything up to event ``idx`` is placed"."""

    def __init__(self, rows: pa.Table, blk: int, max_ms: float, total_ms: float):
        idx, first = np.unique(rows["idx"].to_numpy(), return_index=True)
        t1, ends, home, story = (rows[c].to_numpy()[first] for c in ("t1_ms", "story_end", "home", "story"))
        if blk == 0:        # the state before the first event
            idx, t1 = np.r_[-1, idx], np.r_[0.0, t1]
            ends, home, story = np.r_[False, ends], np.r_[True, home], np.r_[0, story]
        self.idx, self.t, self.home, self.story = idx, t1, home, story
        self.max_ms, self.total_ms = max_ms, total_ms
        at = np.arange(len(idx))
        self.last_story = np.maximum.accumulate(np.where(ends, at, -1)) if len(idx) else at

    def position(self, idx: int) -> int:
        return int(np.searchsorted(self.idx, idx))

    def step(self, p: int) -> int | None:
        """Position of the event the segment after state ``p`` ends on.

        -1 is the tail after the last event, None means the job is covered.
        """
        t, t0 = self.t, self.t[p]
        if t0 >= self.total_ms - TAIL_MS:
            return None
        hi = max(int(np.searchsorted(t, t0 + self.max_ms, "right")) - 1, p)
        while hi + 1 < len(t) and t[hi + 1] - t0 <= self.max_ms:
            hi += 1
        while hi > p and t[hi] - t0 > self.max_ms:
            hi -= 1
        if hi > p:
            s = int(self.last_story[hi])
            return s if s > p else hi
        return p + 1 if p + 1 < len(t) else -1


def _events_by_block(rows: DataFrame, keys: list[str], max_ms: float, width: float,
                     bridges: DataFrame | None) -> DataFrame:
    """Each event in its own block and, near a block's start, in the one before."""
    blk = F.floor(F.col("t1_ms") / width).cast("bigint")
    near = (blk > 0) & (F.col("t1_ms") - blk * width <= max_ms)
    placed = rows.withColumn("__home", blk).withColumn(
        "blk", F.explode(F.when(near, F.array(blk, blk - 1)).otherwise(F.array(blk))))
    placed = placed.withColumn("home", F.col("blk") == F.col("__home")).drop("__home")
    return placed if bridges is None else placed.unionByName(bridges)


def _ways_schema(keys: list[T.StructField]) -> T.StructType:
    """``blk``, left for event ``leave`` after ``hops`` segments if entered after event ``entry``."""
    return T.StructType(keys + [T.StructField(n, T.LongType()) for n in ("blk", "entry", "leave", "hops")])


def _group(fan: int):
    return F.floor(F.col("blk") / fan).cast("bigint")


def _composed(ways: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """The ways of groups of ``fan`` blocks: a group is entered in its first block, and left where a chain of ways leaves it."""
    def compose(key, rows):
        order = np.argsort(-rows["entry"].to_numpy())
        first = rows["blk"].to_numpy().min()
        blk, entry, leave, hops = (rows[c].to_pylist() for c in ("blk", "entry", "leave", "hops"))
        known: dict[int, tuple[int | None, int]] = {}
        for i in order.tolist():        # a way leads to a later event
            beyond, more = known.get(leave[i], (leave[i], 0))
            known[entry[i]] = beyond, hops[i] + more
        found = [(e, *known[e]) for e, b in zip(entry, blk) if b == first]
        return _table(keys, key[:-1], {"blk": (pa.int64(), [key[-1].as_py()] * len(found)),
                                       **{n: (pa.int64(), [f[i] for f in found])
                                          for i, n in enumerate(("entry", "leave", "hops"))}})

    return ways.groupBy(*keys, _group(fan).alias("__group")).applyInArrow(
        compose, _ways_schema([ways.schema[k] for k in keys]))


def _walked(ways: DataFrame, entries: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """(keys, blk, entry, placed) of the blocks that a plan enters, from where it enters their groups."""
    def walk(key, rows, start):
        seen: list[tuple] = []
        if rows.num_rows and start.num_rows:
            blk, leave, hops = (rows[c].to_pylist() for c in ("blk", "leave", "hops"))
            by_entry = {e: i for i, e in enumerate(rows["entry"].to_pylist())}
            at, placed = start["entry"][0].as_py(), start["placed"][0].as_py()
            while at in by_entry:
                i = by_entry[at]
                seen.append((blk[i], at, placed))
                at, placed = leave[i], placed + hops[i]
        return _table(keys, key[:-1], {n: (pa.int64(), [f[i] for f in seen]) for i, n in enumerate(("blk", "entry", "placed"))})

    schema = T.StructType([ways.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("blk", "entry", "placed")])
    grouped = ways.withColumn("__group", _group(fan)).groupBy(*keys, "__group")
    starts = entries.select(*keys, F.col("blk").alias("__group"), "entry", "placed")
    return grouped.cogroup(starts.groupBy(*keys, "__group")).applyInArrow(walk, schema)


def _block_before(blocks: DataFrame, keys: list[str], fan: int):
    """``blocks`` (keys, b) with ``blk``, the job's block before that has events (0 for the first).

    Looked up within groups of ``fan`` blocks, then among groups, then among groups of groups.
    """
    def lag(column, within, order):
        return F.lag(column).over(Window.partitionBy(*keys, *within).orderBy(order))

    level = [F.floor(F.col("b") / fan ** i).cast("bigint").alias(f"__g{i}") for i in range(1, _LEVELS + 1)]
    work = blocks.select("*", *level)
    work = work.withColumn("__p0", lag("b", ["__g1"], "b"))
    last = work.groupBy(*keys, *[f"__g{i}" for i in range(1, _LEVELS + 1)]).agg(F.max("b").alias("__last"))
    for i in range(1, _LEVELS + 1):
        groups = last.withColumn(f"__p{i}", lag("__last", [f"__g{i + 1}"] if i < _LEVELS else [], f"__g{i}"))
        work = work.join(groups.select(*keys, f"__g{i}", f"__p{i}"), [*keys, f"__g{i}"])
        if i < _LEVELS:
            last = last.groupBy(*keys, *[f"__g{j}" for j in range(i + 1, _LEVELS + 1)]).agg(F.max("__last").alias("__last"))
    return work.withColumn("blk", F.coalesce(*[f"__p{i}" for i in range(_LEVELS + 1)], F.lit(0))).drop(
        *[f"__{x}{i}" for x in "gp" for i in range(_LEVELS + 1)])


def _block_entries(rows: DataFrame, totals: DataFrame, keys: list[str], max_ms: float,
                   width: float, bridges: DataFrame, jobs: DataFrame, fan: int) -> DataFrame:
    """Where the plan of each long job enters each of its time blocks.

    A block can only be entered near its start.  For those few states the block
    itself tells where its plan leaves it and after how many segments.  These ways
    are composed over groups of blocks and groups of groups; then the true entry
    goes down again, from groups of groups to blocks.
    """
    def exits(key, rows):
        blk = key[-1].as_py()
        block = _Block(rows, blk, max_ms, rows["total_ms"][0].as_py())
        known: dict[int, tuple[int | None, int]] = {}
        homes = np.flatnonzero(block.home)
        if blk == 0:
            homes = homes[:1]
        elif len(homes):
            homes = homes[(block.t[homes] <= blk * width + max_ms) | (homes == homes[0])]
        for p in map(int, homes):
            path = []
            while p not in known:
                path.append(p)
                q = block.step(p)
                if q is None or q < 0:
                    known[p] = (None, 0)
                elif not block.home[q]:
                    known[p] = (int(block.idx[q]), 1)
                else:
                    p = q
                    continue
                path.pop()
                break
            leave, hops = known[p]
            for p in reversed(path):
                hops += 1
                known[p] = (leave, hops)
        found = [(int(block.idx[p]), *known[p]) for p in map(int, homes)]
        return _table(keys, key, {"blk": (pa.int64(), [blk] * len(found)),
                                  **{n: (pa.int64(), [f[i] for f in found])
                                     for i, n in enumerate(("entry", "leave", "hops"))}})

    long_rows = rows.join(jobs, keys, "left_semi")
    blocks = _events_by_block(long_rows, keys, max_ms, width, bridges).join(totals, keys)
    ways = [cut_lineage(blocks.groupBy(*keys, "blk").applyInArrow(exits, _ways_schema([rows.schema[k] for k in keys])))]
    for _ in range(_LEVELS):
        ways.append(_composed(ways[-1], keys, fan))
    # a job of a thousand million longest segments is one group of groups of blocks
    entries = jobs.select(*keys, F.lit(0).cast("bigint").alias("blk"), F.lit(-1).cast("bigint").alias("entry"),
                          F.lit(0).cast("bigint").alias("placed"))
    for i, level in enumerate(reversed(ways)):
        entries = _walked(level, entries, keys, fan if i else 1 << 62)
    return entries


def plan_segments(events: DataFrame, totals: DataFrame, keys: Sequence[str],
                  seg_max_s: float, stage: bool = True, span: int = BLOCK_SPAN, fan: int = BLOCK_FAN) -> DataFrame:
    """Cut each job into segments of at most ``seg_max_s`` that end on events.

    Preferred cut: the latest story end that fits, else the latest event that
    fits, else one over-long event alone; a remainder of more than 1 ms after
    the last event is a segment of its own.

    ``events(keys, id, t1_ms, story, story_end)`` and ``totals(keys, total_ms)``.
    The greedy rule is sequential, so a job is cut into time blocks ``span``
    longest segments wide and no task ever holds more than one block, or the ways
    through ``fan`` blocks.  Only jobs longer than one block need their block entries
    worked out first; whether there are any is looked up.

    ``stage`` writes the thin event columns once, because they are read more
    than once; leave it off when ``events`` is a stored table.
    """
    if seg_max_s <= 0:
        raise ValueError("seg_max_s must be positive")
    keys, max_ms = list(keys), seg_max_s * 1000.0
    width = span * max_ms
    rows = events.select(*keys, F.col("id").cast("bigint").alias("idx"),
                         F.col("t1_ms").cast("double").alias("t1_ms"),
                         F.coalesce("story_end", F.lit(False)).alias("story_end"),
                         F.col("story").cast("bigint").alias("story"))
    if stage:
        rows = cut_lineage(rows)
    totals = totals.select(*keys, F.col("total_ms").cast("double").alias("total_ms"))
    starts = totals.select(*keys, F.lit(0).cast("bigint").alias("blk"),
                           F.lit(-1).cast("bigint").alias("entry"),
                           F.lit(0).cast("bigint").alias("placed"), "total_ms")
    bridges = None
    longest = rows.agg(F.max("t1_ms")).first()[0]
    if longest is not None and longest >= width:
        # the first event of each block, for the block before it: an over-long
        # event may lie beyond all other events near that block
        far = rows.filter(F.col("t1_ms") >= width)
        firsts = cut_lineage(far.groupBy(*keys, F.floor(F.col("t1_ms") / width).cast("bigint").alias("b"))
                             .agg(F.min(F.struct("idx", "t1_ms", "story_end", "story")).alias("f")))
        bridges = _block_before(firsts, keys, fan).select(*keys, "f.*", "blk", F.lit(False).alias("home"))
        jobs = firsts.select(*keys).distinct()
        entries = _block_entries(rows, totals, keys, max_ms, width, bridges, jobs, fan)
        starts = starts.join(jobs, keys, "left_anti").unionByName(
            entries.join(totals, keys).select(*starts.columns))
    blocks = _events_by_block(rows, keys, max_ms, width, bridges)
    # both sides may come from one table: give this side columns of its own
    starts = starts.select(*[F.col(c).alias(c) for c in starts.columns])

    def cut(key, events, start):
        found: list[tuple] = []
        if start.num_rows:
            if not events.num_rows:
                raise ValueError("no caption events to align segments to")
            total = start["total_ms"][0].as_py()
            block = _Block(events, key[-1].as_py(), max_ms, total)
            n, p = start["placed"][0].as_py(), block.position(start["entry"][0].as_py())
            while True:
                q = block.step(p)
                if q is None:
                    break
                if q < 0:
                    found.append((n, block.t[p], total, block.story[p]))
                    break
                found.append((n, block.t[p], block.t[q], block.story[p + 1]))
                if not block.home[q]:
                    break
                n, p = n + 1, q
        kinds = {"idx": pa.int64(), "t0_ms": pa.float64(), "t1_ms": pa.float64(), "story_first": pa.int64()}
        return _table(keys, key, {c: (kind, [f[i] for f in found]) for i, (c, kind) in enumerate(kinds.items())})

    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("idx", T.LongType()), T.StructField("t0_ms", T.DoubleType()),
        T.StructField("t1_ms", T.DoubleType()), T.StructField("story_first", T.LongType())])
    return (blocks.groupBy(*keys, "blk").cogroup(starts.groupBy(*keys, "blk"))
            .applyInArrow(cut, schema))


# ---- assignment ------------------------------------------------------------

def assign_round_robin(df: DataFrame, idx_col: str, resources, out: str = "resource") -> DataFrame:
    """Resource number ``idx mod n``; without resources, null.

    ``resources`` is a list, or a DataFrame ``(pos, value)`` numbered from 0.
    """
    if isinstance(resources, DataFrame):
        pos = F.col("pos").cast("bigint")
        n = resources.select((pos + 1).alias("n")).orderBy(F.desc("n")).limit(1).scalar()    # null without resources
        table = resources.select(pos.alias("__pos"), F.col("value").alias(out))
        return (df.withColumn("__pos", F.pmod(F.col(idx_col).cast("bigint"), n))
                .join(table, "__pos", "left").drop("__pos"))
    values = list(resources)
    if not values:
        return df.withColumn(out, F.lit(None).cast("string"))
    at = F.pmod(F.col(idx_col).cast("bigint"), F.lit(len(values))) + 1
    return df.withColumn(out, F.element_at(F.array(*map(F.lit, values)), at.cast("int")))
