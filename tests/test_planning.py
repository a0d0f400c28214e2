import random

import pytest
from pyspark.sql import functions as F

from storyline.operators import (assign_round_robin, clean_suffix_start, plan_scenes, plan_segments,
                                 shape_classify)
from storyline.operators.scenes import _drawn
from storyline.registry.timelines import scene_invariants

EVENTS = "job int, id long, story long, t1_ms double, story_end boolean"


def greedy(events, total, max_ms):
    """Brute force over (t1, story, story_end)."""
    out, t0, i = [], 0.0, 0
    while t0 < total - 1.0:
        fits = [k for k in range(i, len(events)) if all(events[j][0] - t0 <= max_ms for j in range(i, k + 1))]
        ends = [k for k in fits if events[k][2]]
        if i >= len(events):
            out.append((t0, total, events[-1][1]))
            break
        cut = ends[-1] if ends else fits[-1] if fits else i
        out.append((t0, events[cut][0], events[i][1]))
        i, t0 = cut + 1, events[cut][0]
    return out


def plan(spark, jobs, seg_s, **kw):
    rows = [(j, k, e[1], e[0], e[2]) for j, (evs, _) in jobs.items() for k, e in enumerate(evs)]
    df = spark.createDataFrame(rows, EVENTS)
    totals = spark.createDataFrame([(j, float(t)) for j, (_, t) in jobs.items()], "job int, total_ms double")
    got = {}
    for r in plan_segments(df, totals, ["job"], seg_s, **kw).collect():
        got.setdefault(r.job, {})[r.idx] = (r.t0_ms, r.t1_ms, r.story_first)
    return {j: [s[i] for i in range(len(s))] for j, s in got.items()}


def steady(n, ms, every):
    return [(800.0 + (k + 1) * ms, k // every, (k + 1) % every == 0) for k in range(n)]


def test_plan_segments_golden(spark):
    jobs = {1: (steady(60, 3000, 1000), 180_800), 2: (steady(40, 3000, 10), 120_800),
            3: (steady(30, 3000, 25), 90_800), 4: ([(120_000.0, 0, False)], 120_000),
            5: (steady(10, 3000, 1000), 32_000)}
    got = plan(spark, {1: jobs[1], 5: jobs[5]}, 30.0)
    assert got[1][0][0] == 0 and got[1][-1][1] == 180_800
    assert all(b - a <= 30_000 for a, b, _ in got[1])
    assert all(x[1] == y[0] for x, y in zip(got[1], got[1][1:]))
    assert got[5][-1] == (30_800.0, 32_000.0, 0) or got[5][-1][1] == 32_000.0
    assert plan(spark, {2: jobs[2]}, 35.0)[2][0][1] == 800 + 30_000      # the story end, not the last fit
    assert plan(spark, {3: jobs[3]}, 20.0)[3][0][1] == 18_800
    assert plan(spark, {4: jobs[4]}, 10.0)[4] == [(0.0, 120_000.0, 0)]


@pytest.mark.parametrize("span, fan", [(1, 2), (1, 1024), (2, 3), (5, 2), (1024, 1024)])
def test_plan_segments_any_block_width(spark, span, fan):
    rng = random.Random(span)
    jobs = {}
    for j in range(25):
        t, events = 0.0, []
        for k in range(rng.randint(1, 120)):
            t += rng.choice([0.0, 200.0, rng.uniform(100, 4000), rng.uniform(100, 4000), 30_000.0, 90_000.0]
                            if j % 2 else [rng.uniform(500, 4000)])
            events.append((t, k // 7, rng.random() < 0.15))
        jobs[j] = (events, t + rng.choice([0.0, 0.5, 1200.0]))
    jobs = {j: v for j, v in jobs.items() if v[1] > 1.0}
    got = plan(spark, jobs, 10.0, span=span, fan=fan)
    for j, (events, total) in jobs.items():
        assert got.get(j, []) == greedy(events, total, 10_000.0), j


def test_plan_segments_errors(spark):
    with pytest.raises(ValueError, match="positive"):
        plan(spark, {1: (steady(3, 1000, 2), 4000)}, 0)
    totals = spark.createDataFrame([(1, 10.0), (2, 4000.0)], "job int, total_ms double")
    events = spark.createDataFrame([(1, 0, 0, 10.0, False)], EVENTS)
    with pytest.raises(Exception, match="no caption events"):
        plan_segments(events, totals, ["job"], 5.0).collect()


# ---- scenes ----------------------------------------------------------------

def scenes(spark, durs, pool, jobs=1, **kw):
    segs, t = [], 0.0
    for i, d in enumerate(durs):
        segs += [(j, i, t, t + d * 1000, 0) for j in range(jobs)]
        t += d * 1000
    df = spark.createDataFrame(segs, "job int, idx long, t0_ms double, t1_ms double, story_first long")
    clips = spark.createDataFrame([(f"p:{i}", f"n/{i}", float(d)) for i, d in enumerate(pool)],
                                  "key string, path string, duration_s double")
    return plan_scenes(df.repartition(kw.pop("parts", 3)), clips, ["job"], **kw).orderBy("job", "idx").collect()


def picks_of(rows, job=0):
    return [s.key for r in rows if r.job == job for s in r.scenes]


@pytest.mark.parametrize("pool", [8, 9, 15, 16, 40, 4096, 4097])
def test_scenes_invariants(spark, pool):
    """One rule for every size of pool."""
    durs = [140.3, 60.0, 51.237, 0.04, 33.0, 95.5, 8.2, 120.0] * 3
    rows = scenes(spark, durs, [20.0] * pool, jobs=2)
    assert len(rows) == 2 * len(durs)
    for r in rows:
        dur = (r.t1_ms - r.t0_ms) / 1000
        if dur < 0.05:
            assert r.scenes == []
            continue
        assert sum(s.dur_s for s in r.scenes) == pytest.approx(dur, abs=0.001)
        assert all(8.0 <= s.dur_s <= 16.0 for s in r.scenes[:-1]) and 0.05 <= r.scenes[-1].dur_s <= 16.0
        assert all(0 <= s.in_s and s.in_s + s.dur_s <= 20.001 for s in r.scenes)
    for job in range(2):
        picks = picks_of(rows, job)
        assert all(len(set(picks[i:i + 7])) == 7 for i in range(len(picks) - 6))
        # the circle is gone through before a clip comes back
        assert len(set(picks)) == min(pool, len(picks))


def test_last_scene_is_in_band_with_the_rest_of_its_segment(spark):
    """What is left below 0.05 s makes a scene of almost 16 s longer than 16 s."""
    first = {j: 8000 + _drawn(f"1234|{j}|0") % 8001 for j in range(2000)}
    long = [(j, ms) for j, ms in first.items() if ms >= 15_980]
    assert long
    rows = [(j, 0, 0.0, ms + 45.0, 0) for j, ms in long] + [(-1, 0, 0.0, 60_000.0, 0)]
    segments = spark.createDataFrame(rows, "conv_id long, idx long, t0_ms double, t1_ms double, story_first long")
    pool = spark.createDataFrame([(f"p:{i}", f"n/{i}", 20.0) for i in range(30)], "key string, path string, duration_s double")
    planned = plan_scenes(segments, pool, ["conv_id"])
    assert max(s.dur_s for r in planned.collect() for s in r.scenes) > 16.02
    lengths = pool.select("key", F.col("duration_s").alias("p_size"))
    for r in scene_invariants(planned, lengths).collect():
        assert r.sum_exact and r.in_band and r.clip_long_enough and r.no_repeat_in_seven and r.filled
    # a scene before the last that is as long is out of the band
    early = planned.withColumn("scenes", F.concat("scenes", "scenes"))
    bad = scene_invariants(early.filter("conv_id >= 0"), lengths).collect()
    assert bad and not any(r.in_band for r in bad)


def test_scenes_do_not_depend_on_later_segments(spark):
    short, long = (scenes(spark, [20.0] * n, [20.0] * 12) for n in (1000, 1100))
    assert short == long[:1000]


def test_scenes_repeatable_and_seeded(spark):
    a = scenes(spark, [100.0] * 6, [18.0, 30.0] * 12, seed=1)
    assert a == scenes(spark, [100.0] * 6, [18.0, 30.0] * 12, seed=1, parts=1)
    assert a != scenes(spark, [100.0] * 6, [18.0, 30.0] * 12, seed=2)


def test_scenes_short_clips_tiny_pool_empty_pool(spark):
    assert all(s.dur_s <= 5.0 for r in scenes(spark, [60.0], [5.0] * 20) for s in r.scenes)
    assert sum(s.dur_s for s in scenes(spark, [60.0], [30.0] * 2)[0].scenes) == pytest.approx(60.0, abs=0.001)
    assert all(s.in_s == 0 for s in scenes(spark, [60.0], [0.0] * 9)[0].scenes)      # unknown lengths
    assert scenes(spark, [60.0], [0.06] * 3)[0].scenes[0].dur_s == 0.06
    with pytest.raises(ValueError, match="empty clip pool"):
        scenes(spark, [60.0], [])


def test_every_clip_is_used(spark):
    # eight clips that last the longest scene, and a thousand that do not
    lengths = [20.0] * 8 + [10.0] * 1000
    rows = scenes(spark, [540.0] * 20, lengths)
    assert len(set(picks_of(rows))) == 1008
    for s in (s for r in rows for s in r.scenes[:-1]):
        assert 8.0 <= s.dur_s <= min(16.0, lengths[int(s.key[2:])])


def test_a_short_clip_shortens_its_own_scenes_only(spark):
    rows = scenes(spark, [400.0] * 3, [60.0] * 7 + [4.0])
    lasts = {True: [], False: []}
    for r in rows:
        assert sum(s.dur_s for s in r.scenes) == pytest.approx(400.0, abs=0.001)
        for s in r.scenes[:-1]:
            lasts[s.key == "p:7"].append(s.dur_s)
    assert set(lasts[True]) == {4.0} and len(lasts[True]) >= 10
    assert min(lasts[False]) >= 8.0 and max(lasts[False]) <= 16.0
    picks = picks_of(rows)
    assert all(len(set(picks[i:i + 7])) == 7 for i in range(len(picks) - 6))


@pytest.mark.parametrize("pool", [8, 11, 12, 13, 31])
def test_laps_have_new_orders_and_meet_without_repeats(spark, pool):
    rows = scenes(spark, [61.0, 0.3, 7.0, 250.0] * 10, ([3.0, 9.0, 30.0, 0.0, 15.5] * 7)[:pool], jobs=3)
    for job in range(3):
        picks = picks_of(rows, job)
        assert all(len(set(picks[i:i + 7])) == 7 for i in range(len(picks) - 6))
        laps = [tuple(picks[i:i + pool]) for i in range(0, len(picks) - pool, pool)]
        assert all(len(set(lap)) == pool for lap in laps)
        assert len(set(laps)) >= min(10, len(laps) // 2)
    assert picks_of(rows, 0) != picks_of(rows, 1)


def test_scenes_repeated_key_takes_the_least_path(spark):
    segments = spark.createDataFrame([(0, 0, 0.0, 20000.0, 0)], "job int, idx long, t0_ms double, t1_ms double, story_first long")
    pool = spark.createDataFrame([("k", "b", 20.0), ("k", "a", 30.0)], "key string, path string, duration_s double")
    for parts in (1, 2):
        assert {s.path for s in plan_scenes(segments, pool.repartition(parts), ["job"]).first().scenes} == {"a"}


def test_round_robin(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,)], "n int")
    assert [r.resource for r in assign_round_robin(df, "n", ["a", "b"]).orderBy("n").collect()] == ["a", "b", "a", "b"]
    assert {r.resource for r in assign_round_robin(df, "n", []).collect()} == {None}
    table = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, value string")
    assert [r.resource for r in assign_round_robin(df, "n", table).orderBy("n").collect()] == ["a", "b", "a", "b"]
    assert {r.resource for r in assign_round_robin(df, "n", table.limit(0)).collect()} == {None}


# ---- shapes ----------------------------------------------------------------

BOX, FULL = (1920, 662, 0, 209), (1920, 1080, 0, 0)


@pytest.mark.parametrize("boxes, dur, trim, kind", [
    ([BOX] * 5, 20.0, None, "static"), ([FULL] * 5, 20.0, None, "none"),
    ([BOX, BOX, (1920, 700, 0, 190), BOX, BOX], 20.0, None, "none"),
    ([(1910, 1075, 5, 2)] * 5, 20.0, None, "none"),
    ([BOX, BOX, FULL, FULL, FULL], 53.0, 13.5, "dynamic"), ([BOX, BOX, FULL, FULL, FULL], 53.0, 45.0, "none"),
    ([BOX, BOX, FULL, FULL, FULL], 53.0, None, "none"), ([FULL, BOX, FULL, FULL, FULL], 53.0, 13.5, "none"),
    ([BOX] * 5, 1.5, None, "none"), ([BOX] * 4 + [None], 20.0, None, "none"),
])
def test_shape_classify(spark, boxes, dur, trim, kind):
    rows = [("k", i, *(b or (None,) * 4)) for i, b in enumerate(boxes)]
    samples = spark.createDataFrame(rows, "key string, slot int, w int, h int, x int, y int")
    clips = spark.createDataFrame([("k", dur, trim)], "key string, dur_s double, trim_s double")
    row = shape_classify(samples, clips, "key").first()
    assert row.kind == kind
    assert (row.w, row.h, row.x, row.y) == (BOX if kind == "static" else (None,) * 4)
    assert row.trim_s == (trim if kind == "dynamic" else 0.0)


def test_clean_suffix_matches_brute_force(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(40):
        dur = 30.0
        ts = sorted(rng.uniform(0, dur) for _ in range(rng.randint(0, 40)))
        good = [rng.random() < (t / dur if k % 2 else 0.95) for t in ts]
        rows += [(k, t, 1920 if g else 1000, 1080) for t, g in zip(ts, good)]
        tail = [g for t, g in zip(ts, good) if t >= dur - 1.5]
        bad = [t for t, g in zip(ts, good) if not g]
        clean = [t for t in ts if not bad or t > bad[-1]]
        want[k] = clean[0] if tail and all(tail) else None
    samples = spark.createDataFrame(rows, "key int, t double, w int, h int")
    clips = spark.range(40).select(F.col("id").cast("int").alias("key"), F.lit(30.0).alias("dur_s"))
    got = {r.key: r.trim_s for r in clean_suffix_start(samples, clips, "key").collect()}
    assert got == want
