import random

import pytest
from pyspark.sql import functions as F

from storyline.operators import (boundary_snap, card_events, job_summary, overlap_clip, running_before,
                                 tiling_check, timeline_chunks)
from storyline.operators.running import blocks_of


def chunk(spark, nbytes, groups, t0=0):
    return spark.createDataFrame([(1, 0, 0, groups, True, nbytes, 0, 0, t0)],
                                 "job int, story_idx int, sent_idx int, groups array<string>, ends_story boolean,"
                                 "nbytes long, i long, first_event long, t0_bytes long")


@pytest.mark.parametrize("ms, lengths, expected", [
    (4000, [20, 10], [900 + 2200 * 2 / 3, 900 + 2200 / 3]),
    (3500, [12], [3500]),
    (3000, [30, 30], [1500, 1500]),
    (1500, [10, 10, 10], [500, 500, 500]),
    (400, [5, 5, 5], [133 + 1 / 3] * 3),      # too short for any repair: stays ordered
])
def test_card_events_split(spark, ms, lengths, expected):
    rows = card_events(chunk(spark, ms * 48, ["x" * n for n in lengths]), ["job"]).orderBy("grp").collect()
    assert [r.t1_ms - r.t0_ms for r in rows] == pytest.approx(expected)
    assert rows[-1].t1_ms == ms and [r.story_end for r in rows] == [False] * (len(rows) - 1) + [True]


def make_units(spark, jobs, seed=1):
    rng = random.Random(seed)
    rows = []
    for job in range(jobs):
        for story in range(rng.randint(1, 200 if job == 0 else 3)):
            n = rng.randint(1, 4)
            for s in range(n):
                cards = ["c" * rng.randint(1, 30) for _ in range(rng.randint(1, 4))]
                rows.append((job, story, s, " ".join(cards), cards, s == n - 1, rng.randint(1, 10**6)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "job int, story_idx int, sent_idx int, text string,"
                                             "groups array<string>, ends_story boolean, nbytes long")


def test_timeline_is_the_sequential_clock(spark):
    rows, units = make_units(spark, 5)
    chunks = timeline_chunks(units, ["job"])
    got = {(r.job, r.i): r for r in chunks.collect()}
    for job in range(5):
        t, card = 38_400, 0
        for i, r in enumerate(sorted(x for x in rows if x[0] == job)):
            c = got[job, i]
            assert (c.story_idx, c.sent_idx, c.t0_bytes, c.first_event) == (r[1], r[2], t, card)
            assert c.t1_ms == (t + r[6]) / 48
            t += r[6] + 48 * (1200 if r[5] else 200)
            card += len(r[4])
    summary = {r.job: r for r in job_summary(chunks, card_events(chunks, ["job"]), ["job"]).collect()}
    assert summary[4].total_ms == t / 48 and summary[4].caption_events == card


def test_result_does_not_depend_on_partitions(spark):
    _, units = make_units(spark, 4, seed=9)
    seen = set()
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = card_events(timeline_chunks(units.repartition(n), ["job"]), ["job"]).collect()
        seen.add(tuple(sorted((r.job, r.id, r.t0_ms, r.t1_ms, r.text) for r in rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


@pytest.mark.parametrize("sizes", [(), (7,), (50, 5), (1000, 100, 10)])
def test_running_before_any_blocks(spark, sizes):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 11}", i, rng.randint(0, 9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    out = running_before(df, ["k"], [*blocks_of(F.col("o"), *sizes), [F.col("o")]],
                         {"s": (F.col("v"), "bigint"), "n": (F.lit(1), "bigint")}).collect()
    assert len(out) == len(rows)
    for r in out:
        earlier = [v for k, o, v in rows if k == r.k and o < r.o]
        assert (r.s, r.n) == (sum(earlier), len(earlier))


def test_no_sort_group_holds_a_whole_job(spark, plan_of):
    _, units = make_units(spark, 2)
    plan = plan_of(timeline_chunks(units, ["job"]))
    assert "hashpartitioning(job#" in plan
    first = plan[plan.index("Window"):plan.index("Window") + 4000]
    assert "__l1_0" in first and "BroadcastNestedLoopJoin" not in plan


# ---- intervals -------------------------------------------------------------

EVENTS = "job int, id int, text string, t0_ms double, t1_ms double"
SEGS = "job int, idx int, t0_ms double, t1_ms double"


def clip(spark, events, segments, **kw):
    ev = spark.createDataFrame([(1, i, f"e{i}", float(a), float(b)) for i, (a, b) in enumerate(events)], EVENTS)
    sg = spark.createDataFrame([(1, i, float(a), None if b is None else float(b))
                                for i, (a, b) in enumerate(segments)], SEGS)
    return ev, sg, overlap_clip(ev, kw.pop("snap", lambda s: s)(sg), ["job"], **kw)


def test_overlap_golden(spark):
    _, _, out = clip(spark, [(0, 1000), (1500, 3000), (9000, 10000)], [(1000, 4000)])
    assert [(r.id, r.t0_ms, r.t1_ms) for r in out.collect()] == [(1, 500.0, 2000.0)]
    _, _, out = clip(spark, [(500, 1500)], [(800, 1200)])
    assert [(r.t0_ms, r.t1_ms) for r in out.collect()] == [(0.0, 400.0)]
    _, _, out = clip(spark, [(500, 1500), (86_399_000, 86_500_000)], [(800, None)])
    assert sorted((r.t0_ms, r.t1_ms) for r in out.collect()) == [(0.0, 700.0), (86_398_200.0, 86_499_200.0)]


def test_each_event_in_one_segment_at_a_fractional_boundary(spark):
    b = 29649.333333
    _, _, out = clip(spark, [(28000, b), (b, 31000)], [(0, b), (b, 40000)], snap=boundary_snap)
    assert sorted((r.id, r.seg_idx) for r in out.collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("width", [500, 60_000, 10**7])
def test_overlap_matches_all_pairs(spark, width):
    rng = random.Random(4)
    events = [(a, a + rng.randint(1, 5000)) for a in (rng.randint(0, 40000) for _ in range(150))]
    segments = [(a, a + rng.randint(1, 9000)) for a in (rng.randint(0, 40000) for _ in range(30))]
    ev, sg, out = clip(spark, events, segments, bucket_ms=width)
    want = sorted((i, j, max(a, s), min(b, e)) for i, (a, b) in enumerate(events)
                  for j, (s, e) in enumerate(segments) if b > s and a < e)
    got = sorted((r.id, r.seg_idx, r.t0_ms + segments[r.seg_idx][0], r.t1_ms + segments[r.seg_idx][0])
                 for r in out.collect())
    assert got == want


def test_inverted_event_fails_or_is_kept(spark):
    with pytest.raises(Exception, match="inverted"):
        clip(spark, [(2000, 1500)], [(0, 4000)])[2].collect()
    assert clip(spark, [(2000, 1500)], [(0, 4000)], on_inverted="keep")[2].first().inverted


def test_overlap_is_an_equi_join(spark, plan_of):
    plan = plan_of(clip(spark, [(0, 1)], [(0, 1)])[2])
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_of_buckets_are_not_broadcast(spark, plan_of):
    """A segment has a row for every bucket it touches, whatever size its table has."""
    _, _, out = clip(spark, [(0, 1)], [(0, 10**9)], bucket_ms=1000)
    joins = [line for line in plan_of(out).splitlines() if "Join" in line and "__bucket" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_tiling(spark):
    sg = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (2, 0, 1.0, 5.0), (2, 1, 6.0, 9.0)], SEGS)
    totals = spark.createDataFrame([(1, 20.0), (2, 10.0)], "job int, total_ms double")
    bad = tiling_check(sg, totals, ["job"]).collect()
    assert sorted((r.job, r.problem) for r in bad) == [
        (2, "first start is not 0"), (2, "gap or overlap"), (2, "last end is not the total")]
