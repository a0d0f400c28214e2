import json
import random

import pytest
from pyspark.sql import functions as F

from storyline.operators import (budget_prefix, carry_status, check_allowed, conservation_check, contract_violations,
                                 demote_stale, first_seen_dedupe, job_report, merge_records, patch_fields,
                                 pick_rendition, pool_coverage, pool_filter, pool_from_clips, progress, job_board,
                                 rank_candidates, resume_filter, segment_problems, shortfall_report, source_fallback,
                                 status_counts, stranded_rows)
from storyline.operators.quality import GOLDEN_VIDEO
from storyline.plans import top_up
from storyline.sources import read_provider_hits

MB = 1024 * 1024


def map_hit(**tiers):
    return {"id": 7, "duration": 12, "tags": "a, b", "videos": tiers}


def v(w, h, size=None, url="u"):
    return {"url": f"{url}{w}x{h}" if url else "", "width": w, "height": h, "size": size}


def parse(spark, hit, layout, **kw):
    df = spark.createDataFrame([(json.dumps(hit), "sea")], "j string, term string")
    return read_provider_hits(df, "j", layout, **kw).collect()


STANDARD = dict(large=v(1920, 1080), medium=v(1280, 720), small=v(960, 540), tiny=v(640, 360))


@pytest.mark.parametrize("hit, kw, size", [
    (map_hit(**STANDARD), {}, (1280, 720)),
    (map_hit(**STANDARD), {"max_h": 1080}, (1920, 1080)),
    (map_hit(large=v(1080, 1920)), {}, None),
    (map_hit(large=v(1920, 1080, url="")), {}, None),
    (map_hit(large=v(0, 0)), {}, None),
    (map_hit(large=v(1920, 1080), medium=v(2048, 858)), {}, (2048, 858)),
    (map_hit(large=v(1920, 1080, 200 * MB), medium=v(1280, 720, 90 * MB), small=v(960, 540, 10 * MB)), {}, (960, 540)),
    (map_hit(large=v(1920, 1080, 200 * MB), medium=v(1280, 720, 90 * MB)), {}, (1280, 720)),
    (map_hit(small=v(960, 540, 200 * MB), tiny=v(640, 360, 90 * MB)), {}, (960, 540)),
    (map_hit(medium=v(1280, 720, "huge"), small=v(960, 540, 5)), {}, (1280, 720)),
    ({**map_hit(**STANDARD), "duration": 0}, {}, None),
])
def test_map_layout(spark, hit, kw, size):
    rows = parse(spark, hit, "map", **kw)
    assert ([(r.width, r.height) for r in rows] or [None]) == [size]
    if rows:
        assert (rows[0].key, rows[0].term, rows[0].tags, rows[0].duration_s) == ("pixabay:7", "sea", "a, b", 12.0)


def f(w, h, size=None, **kw):
    return {"link": f"l{w}x{h}", "width": w, "height": h, "size": size, **kw}


@pytest.mark.parametrize("files, link", [
    ([f(None, None), f(1280, 720)], "l1280x720"), ([f(None, None), f(3, None)], "lNonexNone"),
    ([f(720, 1280)], None), ([f(1920, 1080), f(1280, 720), f(640, 360)], "l1280x720"),
    ([f(960, 540), f(640, 360)], "l960x540"), ([f(1280, 720, 90 * MB), f(640, 360, MB)], "l640x360"),
    ([{**f(1280, 720), "link": None}], None),
])
def test_array_layout(spark, files, link):
    for name in ("video_files", "video_versions"):
        rows = parse(spark, {"id": 9, "duration": None, name: files}, "array")
        assert ([r.download_url for r in rows] or [None]) == [link]
        assert all(r.duration_s == 0.0 and r.key == "pexels:9" for r in rows)


def test_array_layout_aliases(spark):
    row = parse(spark, {"id": 1, "duration": 5, "video_files": [], "video_versions": [f(1280, 720, bitrate=77)]}, "array")[0]
    assert (row.bitrate, row.duration_s) == (77, 5.0)


def test_pick_rendition_rows_agree_with_json(spark, plan_of):
    rows = [("a", f"u{i}", w, h, s, i) for i, (w, h, s) in enumerate(
        [(1920, 1080, None), (1280, 720, 90 * MB), (1280, 720, 9), (640, 360, 1), (None, None, None)])]
    df = spark.createDataFrame(rows, "hit string, url string, width int, height int, size long, tie int")
    assert pick_rendition(df, ["hit"]).first().url == "u2"
    only = df.filter("width is null")
    assert pick_rendition(only, ["hit"]).count() == 0 and pick_rendition(only, ["hit"], "array").first().url == "u4"
    assert "Window" not in plan_of(pick_rendition(df, ["hit"]))


def test_first_seen_and_fallback(spark):
    hits = spark.createDataFrame([("pixabay", "sea", "pixabay:1", 0, 0), ("pixabay", "sea", "pixabay:2", 0, 1),
                                  ("pexels", "sea", "pixabay:1", 1, 0), ("pexels", "sky", "pexels:1", 1, 1)],
                                 "source string, term string, key string, rank int, pos int")
    kept = first_seen_dedupe(hits, "key", ["rank", "pos"]).orderBy("rank", "pos").collect()
    assert [r.key for r in kept] == ["pixabay:1", "pixabay:2", "pexels:1"] and kept[0].source == "pixabay"
    statuses = spark.createDataFrame([("pixabay", "sea", True), ("pexels", "sea", False), ("pexels", "sky", True),
                                      ("third", "sea", False)], "source string, term string, ok boolean")
    good, report = source_fallback(hits, statuses)
    assert {r.source: r.state for r in report.collect()} == {"pixabay": "ok", "pexels": "partial", "third": "failed"}
    assert good.count() == 4     # what a term gave before it failed stays
    with pytest.raises(Exception, match="all terms failed"):
        source_fallback(hits, statuses, on_all_failed="fail")[1].collect()


CATALOG = "key string, term string, raw string, norm string, duration_s double, norm_duration_s double"


def test_pool_and_stranded(spark):
    cat = spark.createDataFrame([
        ("a:1", "Sea", "r", "n1", 10.0, None), ("a:2", "sky", "r", "n2", 10.0, None), ("a:3", "sea", "r", None, 10.0, None),
        ("a:4", "sea", "r", "n4", 10.0, 3.0), ("a:5", "sea", "r", "n5", 3.0, 9.0), ("a:6", "sea", "r", "n6", 9.0, 0.0),
        ("a:7", None, "r", "n7", 9.0, None), ("a:8", "sea", None, "", 9.0, None), ("a:9", "sea", "r", "", 9.0, None)], CATALOG)
    blocked = spark.createDataFrame([("a:6", "bad"), ("a:9", "bad")], "key string, reason string")
    assert [r.key for r in pool_filter(cat, blocked, ["SEA"]).collect()] == ["a:1", "a:5"]
    assert [r.key for r in pool_filter(cat, blocked).collect()] == ["a:1", "a:2", "a:5", "a:7"]
    assert [r.key for r in stranded_rows(cat, blocked, ["sea"]).collect()] == ["a:3"]
    paths = spark.createDataFrame([("a:1", "p"), ("a:2", None)], "key string, path string")
    assert [(r.key, r.duration_s) for r in pool_from_clips(cat, paths).collect()] == [("a:1", 10.0)]


def test_coverage_and_shortfall(spark):
    pool = spark.createDataFrame([("j", 30.0)] * 16 + [("other", 999.0)], "job string, duration_s double")
    for need, enough in ((300.0, True), (400.0, True), (420.0, False)):
        needed = spark.createDataFrame([("j", need)], "job string, needed_s double")
        row = pool_coverage(pool, needed, ["job"]).first()
        assert (row.cover_s, row.enough) == (480.0, enough)
        assert shortfall_report(pool, needed, ["job"]).count() == (0 if enough else 1)
    none = spark.createDataFrame([("x", 1.0)], "job string, needed_s double")
    assert shortfall_report(pool, none, ["job"]).first().missing_s == pytest.approx(1.2)


def test_budget_prefix_brute_force(spark):
    rng = random.Random(6)
    rows = [("b%d" % (i % 3 % 2), i, rng.choice([640, 1280, 1920]), rng.choice([5.0, 5.0, 7.25, rng.uniform(1, 60)]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "job string, ord long, width int, duration_s double")
    need = spark.createDataFrame([("b0", 900.5), ("b1", 40.0)], "job string, need_s double")
    got = {(r.job, r.ord) for r in budget_prefix(df, need, ["job"]).collect()}
    want = set()
    for job, need_s in (("b0", 900.5), ("b1", 40.0)):
        total = 0.0
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2] < 1280, -r[3], r[1])):
            if total >= need_s:
                break
            want.add((job, r[1]))
            total += round(r[3], 6)
    assert got == want
    top = rank_candidates(df, 5).collect()
    assert [r.ord for r in top] == [r[1] for r in sorted(rows, key=lambda r: (r[2] < 1280, -r[3], r[1]))[:5]]


def test_top_up_plan(spark):
    hits = spark.createDataFrame([("j", "a", 1280, 10.0, 0), ("j", "a", 1280, 10.0, 1), ("j", "b", 1280, 30.0, 2),
                                  ("j", "c", 1280, 20.0, 3), ("j", "d", 640, 50.0, 4)],
                                 "job string, key string, width int, duration_s double, ord long")
    catalog = spark.createDataFrame([("b",)], "key string")
    blocked = spark.createDataFrame([("zzz",)], "key string")
    pool = spark.createDataFrame([("j", 100.0)], "job string, duration_s double")
    needed = spark.createDataFrame([("j", 100.0)], "job string, needed_s double")
    assert [r.key for r in top_up(hits, catalog, blocked, pool, needed, ["job"], ["ord"]).collect()] == ["c"]


# ---- merging and state -----------------------------------------------------

def test_merge_patch_carry_demote(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "key string, v int")
    assert {tuple(r) for r in merge_records(old, new, "key").collect()} == {("a", 1), ("b", 9), ("c", 3)}
    target = spark.createDataFrame([("a", "sea", 1.0), ("b", "", 2.0), ("c", "x", 3.0)], "key string, term string, d double")
    patch = spark.createDataFrame([("a", "new", 9.0), ("b", "new", 8.0)], "key string, term string, d double")
    got = {tuple(r) for r in patch_fields(target, patch, "key", keep=("term",)).collect()}
    assert got == {("a", "sea", 9.0), ("b", "new", 8.0), ("c", "x", 3.0)}
    plan = spark.createDataFrame([(0, 5.0), (1, 5.0)], "idx int, dur_s double")
    before = spark.createDataFrame([(0, "done", "p", None)], "idx int, state string, path string, problems string")
    carried = carry_status(plan, before, "idx").orderBy("idx")
    assert [(r.state, r.path) for r in carried.collect()] == [("done", "p"), ("pending", None)]
    probes = spark.createDataFrame([(0, 5.2)], "idx int, probe_s double")
    row = demote_stale(carried, probes, "idx").filter("demoted").collect()
    assert [(r.idx, r.state, r.path) for r in row] == [(0, "pending", None)]
    near = spark.createDataFrame([(0, 5.1)], "idx int, probe_s double")
    assert demote_stale(carried, near, "idx").filter("demoted").count() == 0


def test_progress_and_board(spark):
    phases = spark.createDataFrame([("a", "tts", True), ("a", "concat", False), ("b", "concat", True), ("c", "tts", False)],
                                   "job string, phase string, done boolean")
    segs = spark.createDataFrame([("a", 0, "done"), ("a", 1, "rendering"), ("a", 2, None), ("d", 0, "done")],
                                 "job string, idx int, state string")
    rows = {r.job: r for r in progress(phases, segs, ["job"]).collect()}
    assert rows["a"].progress == 0.3333 and rows["a"].segments == {"done": 1, "rendering": 1, "pending": 1}
    assert rows["a"].phases_done == ["tts"] and rows["b"].progress == 1.0
    assert (rows["c"].progress, rows["c"].segments_total, rows["c"].segments) == (0.0, 0, {})
    assert rows["d"].progress == 1.0
    outs = spark.createDataFrame([("a", 1, None), ("b", 3, 10), ("c", 2, None)], "job string, updated int, size int")
    assert [r.job for r in job_board(progress(phases, segs, ["job"]), outs, ["job"]).collect()] == ["b", "c", "a", "d"]
    assert {r.state: r.n for r in status_counts(segs).collect()} == {"done": 2, "rendering": 1, "pending": 1}


def test_resume_and_allowed(spark):
    work = spark.createDataFrame([(0,), (1,), (2,)], "idx int")
    done = spark.createDataFrame([(0, "done", "o", "h"), (1, "done", None, "h")],
                                 "idx int, state string, output string, params_hash string")
    assert [r.idx for r in resume_filter(work, done, "h", ["idx"]).orderBy("idx").collect()] == [1, 2]
    with pytest.raises(Exception, match="different parameters"):
        resume_filter(work, done, "other", ["idx"]).collect()
    voices = spark.createDataFrame([("en-A",), ("xx",), ("xx",), (None,)], "voice string")
    bad = check_allowed(voices, "voice", ["en-B", "en-A", "de-C"], hint_prefix="en-").collect()
    assert sorted((r.value or "", r.n, r.hints) for r in bad) == [("", 1, "en-A, en-B"), ("xx", 2, "en-A, en-B")]
    assert check_allowed(voices, "voice", []).count() == 0
    names = spark.createDataFrame([("en-B",), ("en-A",), ("de-C",), (None,)], "value string")
    assert check_allowed(voices, "voice", names, hint_prefix="en-").collect() == bad
    assert {r.hints for r in check_allowed(voices, "voice", names, max_hints=1).collect()} == {"de-C"}
    assert check_allowed(voices, "voice", names.limit(0)).count() == 0


# ---- quality ---------------------------------------------------------------

def test_contract(spark):
    good = {k: v for k, v in GOLDEN_VIDEO.items()}
    df = spark.createDataFrame([good, {**good, "width": 1280, "avg_frame_rate": "29/1"}, {**good, "profile": None}])
    rows = [sorted(r.violations) for r in contract_violations(df, GOLDEN_VIDEO, ("avg_frame_rate",)).collect()]
    assert rows == [[], ["width=1280 want 1920"], ["profile=null want High"]]


def test_report(spark):
    segs = spark.createDataFrame([("a", 0, "done", "p", 5.0), ("a", 1, "done", None, 5.0), ("a", 2, None, None, 5.0),
                                  ("b", 0, "done", "p", 5.0), ("c", 0, "done", "p", 5.0)],
                                 "job string, idx int, state string, path string, dur_s double")
    probes = spark.createDataFrame([("a", 0, 5.3), ("b", 0, 5.05)], "job string, idx int, probe_s double")
    problems = segment_problems(segs, probes, ["job"])
    rows = {r.job: r for r in job_report(segs.select("job").distinct(), problems, ["job"]).collect()}
    assert (rows["a"].n_problems, rows["b"].ok, rows["c"].first_problem) == (3, True, "segment 0: probe failed")
    events = spark.createDataFrame([("a",), ("a",), ("b",)], "job string")
    lines = spark.createDataFrame([("a",), ("b",), ("c",)], "job string")
    bad = conservation_check(events, lines, ["job"], segs).collect()
    assert sorted((r.job, r.events, r.captions) for r in bad) == [("a", 2, 1), ("c", 0, 1)]
