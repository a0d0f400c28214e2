import datetime
import hashlib
import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyline.operators import cache
from storyline.operators import PermanentError, cached_enrich, overlap_clip, progress_stats, split_stories, split_stories_blocks
from storyline.plans import build_plan, build_timeline, job_stories, segment_captions, verify
from storyline.sources import (read_assets, read_blocklist, read_catalog, read_job_state, read_log, read_script_lines, read_scripts,
                               read_text_folders, read_text_index, read_texts, write_captions, write_timeline)
from storyline.sources.readers import numbered_lines
from storyline.sources.packs import listed, write_text_packs
from storyline.streaming import (checkpoint_merge, read_latest, read_progress, stream_first_seen, stream_progress,
                                 stream_tail, stream_upsert)


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_read_scripts(spark, tmp_path):
    a = put(f"{tmp_path}/z/a.txt", b"\xef\xbb\xbfSTORY: One\r\nA b.\r\n\r\nC.\x0bD\x0cE\rF")
    b = put(f"{tmp_path}/y/b.txt", "---\nonly\n---\nSTORY: Two\nx")
    rows = read_scripts(spark, [a, b]).orderBy("ord").collect()
    assert [r.text for r in rows] == ["STORY: One\nA b.\n\nC.\nD\nE\nF", "---\nonly\n---\nSTORY: Two\nx"]
    stories = split_stories(read_scripts(spark, [a, b]), ["ord"]).orderBy("ord", "story_idx").collect()
    assert [(r.ord, r.story_idx, r.title) for r in stories] == [(0, 0, "One"), (1, 0, None), (1, 1, "Two")]


def test_catalog_and_blocklist_files(spark, tmp_path):
    good = put(f"{tmp_path}/i.json", json.dumps({"a:1": {"provider": "a", "id": "1", "duration_s": 5.5, "norm": "n"},
                                                 "a:2": {"term": "sea"}}))
    bad = put(f"{tmp_path}/bad.json", "{oops")
    rows = {r.key: r for r in read_catalog(spark, good).collect()}
    assert rows["a:1"].duration_s == 5.5 and rows["a:2"].term == "sea" and rows["a:2"].norm is None
    for path in (bad, f"{tmp_path}/missing.json"):
        assert read_catalog(spark, path).count() == 0 and read_blocklist(spark, path).count() == 0
    block = put(f"{tmp_path}/b.json", json.dumps({"blocked": {"a:1": "city"}}))
    assert [tuple(r) for r in read_blocklist(spark, block).collect()] == [("a:1", "city")]


def test_read_assets(spark, tmp_path):
    for name in ("one/b.png", "one/a.png", "one/c.jpg", "one/note.txt", "two/d.webp", "three/x.txt"):
        put(f"{tmp_path}/{name}", name)
    rows = read_assets(spark, [f"{tmp_path}/two", f"{tmp_path}/one"]).orderBy("dir_ord", "ext_ord", "name").collect()
    assert [r.name for r in rows] == ["d.webp", "a.png", "b.png", "c.jpg"]
    assert rows[1].sha256 == hashlib.sha256(b"one/a.png").hexdigest()
    with pytest.raises(ValueError, match="no images"):
        read_assets(spark, [f"{tmp_path}/one", f"{tmp_path}/three"])
    with pytest.raises(FileNotFoundError):
        read_assets(spark, [f"{tmp_path}/none"])


def test_read_job_state_and_log(spark, tmp_path):
    put(f"{tmp_path}/jobs/j1/state.json", json.dumps({
        "params_hash": "h", "phases": {"tts": {"done": True, "n": 3}, "concat": {}},
        "segments": [{"idx": 0, "state": "done", "t0_ms": 0, "t1_ms": 9.5, "scenes": [{"key": "k", "in_s": 1}]}, {"idx": 1}]}))
    put(f"{tmp_path}/jobs/j2/state.json", "{nope")
    phases, segments = read_job_state(spark, f"{tmp_path}/jobs")
    assert {(r.job_id, r.phase, r.done) for r in phases.collect()} == {("j1", "tts", True), ("j1", "concat", False)}
    rows = segments.orderBy("idx").collect()
    assert [(r.job_id, r.state, r.t1_ms) for r in rows] == [("j1", "done", 9.5), ("j1", None, None)]
    assert rows[0].scenes[0].key == "k"
    log = put(f"{tmp_path}/build.log", "[10:00:01] ---- session ----\n[10:00:02] hello\n  more\n")
    got = [(r.time, r.message, r.is_session) for r in read_log(spark, log, numbered=True).orderBy("line_no").collect()]
    assert got == [("10:00:01", "---- session ----", True), ("10:00:02", "hello", False), (None, "  more", False)]
    assert read_log(spark, log).count() == 3 and read_log(spark, f"{tmp_path}/none.log").count() == 0


@pytest.mark.parametrize("split", ["700", "4096", "1m"])
def test_lines_are_numbered_over_splits(spark, tmp_path, split):
    texts = {f"{tmp_path}/logs/{name}.log": sep.join(f"[10:00:{i % 60:02d}] line {i} " + "é" * (i % 50) for i in range(n)) + end
             for name, n, sep, end in (("a", 900, "\n", "\n"), ("b", 333, "\r\n", ""), ("c", 1, "\n", "\n\n"), ("d", 40, "\n\n", "x\ry"))}
    for path, text in texts.items():
        put(path, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {}
        for r in numbered_lines(spark, f"{tmp_path}/logs").collect():
            got.setdefault("/" + r.path.removeprefix("file:").lstrip("/"), {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for path, text in texts.items():
        lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
        assert got[path] == dict(enumerate(lines))


def test_long_scripts_are_split_like_short_ones(spark, tmp_path):
    body = "\n".join(f"line {i} é" if i % 11 else ["", "---", "STORY: number %d" % i][i % 3] for i in range(3000))
    put(f"{tmp_path}/in/a.txt", b"\xef\xbb\xbf" + body.replace("\n", "\r\n").encode())
    put(f"{tmp_path}/in/b.txt", "no title\x0b\n---\n---\rtext\n\n\x0cmore")
    whole = split_stories(read_scripts(spark, f"{tmp_path}/in"), ["script_id"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = read_script_lines(spark, f"{tmp_path}/in")
        assert lines.select("path", "block").distinct().count() > 10
        blocks = split_stories_blocks(lines, ["script_id"], order=("at", "sub")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, whole.collect()), key=lambda r: r[:2]) == sorted(map(tuple, blocks), key=lambda r: r[:2])
    assert len(blocks) > 100


# ---- enrichment ------------------------------------------------------------

def counting(folder):
    def fn(batch):
        for key in batch["key"]:
            with open(f"{folder}/calls", "a") as out:
                out.write(f"{key}\n")
        return pd.DataFrame({"key": batch["key"], "n": batch["text"].str.len()})
    return fn


def test_cached_enrich_calls_once_per_key(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 7}", "x" * (i % 7)) for i in range(30)], "i int, key string, text string")
    fn, cache = counting(tmp_path), f"{tmp_path}/cache"
    out = cached_enrich(rows, "key", fn, "n int", cache, concurrency=3, inputs=["text"], ord=["i"]).orderBy("i").collect()
    assert [r.n for r in out] == [i % 7 for i in range(30)]
    assert [r.was_cached for r in out] == [False] * 7 + [True] * 23
    assert sorted(open(f"{tmp_path}/calls").read().split()) == sorted(f"k{i}" for i in range(7))
    more = spark.createDataFrame([(0, "k1", "x"), (1, "new", "yyyy")], rows.schema)
    again = cached_enrich(more, "key", fn, "n int", cache, inputs=["text"], ord=["i"])
    assert [(r.n, r.was_cached) for r in again.orderBy("i").collect()] == [(1, True), (4, False)]
    assert len(open(f"{tmp_path}/calls").read().split()) == 8
    stats = progress_stats(again, elapsed_s=2.0, total=4).first()
    assert (stats.done, stats.cached, stats.net, stats.rate, stats.eta_s) == (2, 1, 1, 1.0, 2.0)


def test_cached_enrich_retries(spark, tmp_path):
    rows = spark.createDataFrame([("k", "x")], "key string, text string")

    def flaky(kind, fails):
        def fn(batch):
            with open(f"{tmp_path}/tries-{kind}", "a") as out:
                out.write(".")
            if os.path.getsize(f"{tmp_path}/tries-{kind}") <= fails:
                raise PermanentError("never") if kind == "perm" else OSError("reset")
            return pd.DataFrame({"key": batch["key"], "n": [1]})
        return fn

    def run(kind, fails, attempts):
        return cached_enrich(rows, "key", flaky(kind, fails), "n int", f"{tmp_path}/c-{kind}", inputs=["text"],
                             ord=["key"], attempts=attempts, first_delay_s=0.01).first().n

    assert run("some", 2, 6) == 1 and os.path.getsize(f"{tmp_path}/tries-some") == 3
    with pytest.raises(Exception, match="failed after 3 attempts"):
        run("all", 10**6, 3)
    with pytest.raises(Exception, match="never"):
        run("perm", 10**6, 6)


def test_cached_enrich_keeps_successes_before_it_fails(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(40)], "key string, text string")
    bad, calls = f"{tmp_path}/bad", f"{tmp_path}/calls"
    put(bad, "k7")

    def fn(batch):
        with open(bad) as names:
            if names.read() in set(batch["key"]):
                raise PermanentError("refused")
        with open(calls, "a") as out:
            out.write("".join(f"{k} " for k in batch["key"]))
        return pd.DataFrame({"key": batch["key"], "n": batch["text"].str.len()})

    def run():
        return cached_enrich(rows, "key", fn, "n int", f"{tmp_path}/cache", ["key"], inputs=["text"])

    with pytest.raises(RuntimeError, match="k7: PermanentError: refused"):
        run()
    assert len(open(calls).read().split()) == 39
    put(bad, "none")
    out = run().collect()
    assert {r.key: r.n for r in out} == {f"k{i}": i for i in range(40)}
    assert [r.key for r in out if not r.was_cached] == ["k7"] and open(calls).read().split()[39:] == ["k7"]
    with pytest.raises(ValueError, match="ord"):
        cached_enrich(rows, "key", fn, "n int", f"{tmp_path}/cache", [])


def test_a_small_batch_reads_only_files_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "RANGE_ROWS", 50)
    path = f"{tmp_path}/cache"
    rows = spark.createDataFrame([(f"k{i}", "x" * (i % 9)) for i in range(300)], "key string, text string")

    def enrich(df):
        return cached_enrich(df, "key", lambda b: pd.DataFrame({"key": b["key"], "n": b["text"].str.len()}), "n int", path,
                             ["key"], inputs=["text"])

    def files(df):
        return {f.split("/data/")[1].rsplit("/", 1)[0] for f in df.inputFiles() if "/data/run=" in f}

    for low, high in ((0, 200), (200, 201), (201, 300)):
        enrich(rows.filter(F.substring("key", 2, 9).cast("int").between(low, high - 1)))
    runs = sorted(os.listdir(f"{path}/data"))
    assert [len([r for r in os.listdir(f"{path}/data/{run}") if r.startswith("range=")]) for run in runs] == [4, 1, 2]
    one = enrich(rows.filter("key = 'k77'"))
    old = {f for f in files(one) if f.split("/")[0] in runs}
    assert len(old) == 1 and next(iter(old)).startswith(runs[0]) and [(r.n, r.was_cached) for r in one.collect()] == [(5, True)]
    # the new run has nothing, and is not listed
    assert len(os.listdir(f"{path}/manifest")) == len([f for f in os.listdir(f"{path}/manifest") if "crc" in f]) + 3
    everything = enrich(rows)
    assert {r.key: r.n for r in everything.collect()} == {f"k{i}": i % 9 for i in range(300)} and not everything.filter("not was_cached").count()
    # what a run without a manifest left behind is not read
    os.rename(f"{path}/manifest/{runs[1].removeprefix('run=')}.json", f"{tmp_path}/lost")
    assert [r.key for r in enrich(rows).filter("not was_cached").collect()] == ["k200"]
    assert cache.compact_cache(spark, path, "all") == 3
    assert enrich(rows).filter("was_cached").count() == 300 and len(cache.Cache(spark, path, rows.schema).entries()) == 1


def test_scripts_are_numbered_by_their_path(spark, tmp_path):
    put(f"{tmp_path}/scripts/a.txt", "A")
    put(f"{tmp_path}/scripts2/b file.txt", "B")
    put(f"{tmp_path}/scripts2/c.txt", "C")
    rows = read_scripts(spark, [f"{tmp_path}/scripts", f"{tmp_path}/scripts2", f"{tmp_path}/scr*2/c.txt"]).collect()
    assert sorted((r.ord, r.text) for r in rows) == [(0, "A"), (1, "B"), (1, "C"), (2, "C")]


# ---- streams ---------------------------------------------------------------

def test_checkpoint_merge_survives_a_kill(spark, tmp_path):
    schema = "key int, v int"
    for i, (a, b) in enumerate([(0, 10), (10, 20), (20, 25)]):
        spark.createDataFrame([(k, k) for k in range(a, b)], schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")

    def run(*folders):
        for n in folders:
            os.makedirs(f"{tmp_path}/src", exist_ok=True)
            for name in os.listdir(f"{tmp_path}/in{n}"):
                if name.endswith(".parquet"):
                    os.rename(f"{tmp_path}/in{n}/{name}", f"{tmp_path}/src/{n}-{name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
        checkpoint_merge(stream, f"{tmp_path}/out", "key", f"{tmp_path}/cp").awaitTermination()
        return read_latest(spark, f"{tmp_path}/out", "key").count()

    assert run(0) == 10          # saved before the kill
    assert run(1, 2) == 25       # the restart goes on behind it
    assert sum(len([n for n in names if n.startswith("batch=")]) for _, names, _ in os.walk(f"{tmp_path}/out")) == 3


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 5, i % 3, "done" if i % 4 == 0 else "rendering", i) for i in range(60)]
    df = spark.createDataFrame(rows, "job int, idx int, state string, ts int")
    df.repartition(4).write.parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    stream_progress(stream(), f"{tmp_path}/p", ["job"], f"{tmp_path}/c1").awaitTermination()
    last = {}
    for job, idx, state, ts in rows:
        last[job, idx] = state
    got = {r.job: r.progress for r in read_progress(spark, f"{tmp_path}/p", ["job"]).collect()}
    assert got == {j: round(sum(s == "done" for (k, _), s in last.items() if k == j) / 3, 4) for j in range(5)}
    stream_upsert(stream(), f"{tmp_path}/u", "job", f"{tmp_path}/c2", ["ts"]).awaitTermination()
    assert {(r.job, r.ts) for r in read_latest(spark, f"{tmp_path}/u", "job", ["ts"]).collect()} == {
        (j, max(t for k, _, _, t in rows if k == j)) for j in range(5)}
    (stream_first_seen(stream(), "job", unbounded=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c3")
     .trigger(availableNow=True).start(f"{tmp_path}/f").awaitTermination())
    assert sorted(r.job for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [0, 1, 2, 3, 4]


def tailed(spark, tmp_path, **options):
    """Poll until nothing is left; messages and the number of batches that had lines."""
    query = (stream_tail(spark, f"{tmp_path}/logs", f"{tmp_path}/pos", **options).writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/cp").start(f"{tmp_path}/out"))
    query.processAllAvailable()
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    query.stop()
    query.awaitTermination(30)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted(r.message for r in rows), sizes


def test_stream_tail_follows_files_that_grow(spark, tmp_path):
    put(f"{tmp_path}/logs/a.log", "[10:00:00] one\n[10:00:01] two\n")
    assert tailed(spark, tmp_path)[0] == ["one", "two"]
    assert tailed(spark, tmp_path) == (["one", "two"], [])
    with open(f"{tmp_path}/logs/a.log", "a") as log:
        log.write("[10:00:02] three\r\n[10:00:03] unfini")
    put(f"{tmp_path}/logs/b.log", "[10:00:02] four\n")
    put(f"{tmp_path}/logs/.hidden", "no\n")
    assert tailed(spark, tmp_path)[0] == ["four", "one", "three", "two"]
    with open(f"{tmp_path}/logs/a.log", "a") as log:
        log.write("shed\n")
    assert tailed(spark, tmp_path)[0] == ["four", "one", "three", "two", "unfinished"]
    put(f"{tmp_path}/logs/a.log", "[11:00:00] anew\n")      # cut and written again
    assert tailed(spark, tmp_path)[0] == ["anew", "four", "one", "three", "two", "unfinished"]


def test_stream_tail_is_bounded(spark, tmp_path):
    lines = [f"line {i:04d} " + "x" * (i % 40) for i in range(600)] + ["y" * 5000, "last"]
    put(f"{tmp_path}/logs/a.log", "".join(f"{line}\n" for line in lines[:300]))
    options = {"max_bytes": 2000}
    got, sizes = tailed(spark, tmp_path, **options)
    assert got == sorted(lines[:300]) and max(sizes) <= 2000 // 10 and len(sizes) >= 4
    put(f"{tmp_path}/logs/a.log", "".join(f"{line}\n" for line in lines))
    got, sizes = tailed(spark, tmp_path, **options)
    assert got == sorted(lines) and max(sizes) <= 2000 // 10 and len(sizes) >= 5


def test_stream_tail_takes_a_portion_of_every_file(spark, tmp_path):
    lines = {name: [f"{name} {i:04d} " + "x" * 20 for i in range(150)] for name in "abc"}
    for name, own in lines.items():
        put(f"{tmp_path}/logs/{name}.log", "".join(f"{line}\n" for line in own))
    got, sizes = tailed(spark, tmp_path, max_bytes=2000)
    assert got == sorted(sum(lines.values(), [])) and max(sizes) <= 3 * 2000 // 28
    assert len(sizes) <= 3       # not as many batches as all files together have portions


def test_stream_first_seen_is_the_least_across_batches(spark, tmp_path):
    rows = [(0, "a", 50, "late"), (0, "b", 10, "b-first"), (0, "a", 40, "a-40"), (0, None, 5, "null key"),
            (1, "a", 20, "a-first"), (1, "b", 30, "b-later"), (1, "c", 25, None), (1, "d", None, "no time"),
            (2, "b", 12, "b-12"), (2, "c", 25, "c-tie"), (2, "e", 90, "e-first"), (2, "a", 60, "a-60"),
            (3, "close", 100000, "end"),       # closes all windows, and so do the next
            (4, "a", 150000, "a-again"), (5, "close", 300000, "end")]
    folder = tmp_path / "in"
    for batch in range(6):
        spark.createDataFrame([(k, datetime.datetime.fromtimestamp(t) if t is not None else None, t, v) for b, k, t, v in rows if b == batch],
                              "key string, ts timestamp, n int, value string").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema("key string, ts timestamp, n int, value string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = (stream_first_seen(stream, "key", "ts", "200 seconds", order=["value"], keep="1000 seconds").writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out"))
    query.awaitTermination()
    got = sorted((r.key or "", r.n, r.value or "") for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("", 5, "null key"), ("a", 20, "a-first"), ("a", 150000, "a-again"), ("b", 10, "b-first"),
                   ("c", 25, "c-tie"), ("close", 100000, "end"), ("e", 90, "e-first")]
    # what is over is forgotten
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12
    with pytest.raises(ValueError):
        stream_first_seen(stream, "key")
    with pytest.raises(ValueError):
        stream_first_seen(stream, "key", "ts", "soon")


# ---- packed texts ----------------------------------------------------------

def test_text_packs(spark, tmp_path):
    path = f"{tmp_path}/packs"
    rows = [(f"job {i % 7}", i, k, f"line {k} of {i} é" if k else "") for i in range(230) for k in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "job string, seg int, k int, value string").repartition(5)
    want = {(f"job {i % 7}", i): "".join(f"line {k} of {i} é\n" if k else "\n" for k in range(i % 4 + 1)) for i in range(230)}
    write_text_packs(df, path, ["job", "seg"], ["k"], files=20, partitions=3)
    assert {(r.job, r.seg): r.value for r in read_texts(spark, path).collect()} == want
    files = sorted(os.listdir(f"{path}/packs"))
    texts = [f for f in files if f.endswith(".txt")]
    assert 12 <= len(texts) <= 15 and len(files) == 2 * len(texts)
    assert {f.split(".")[0] for f in texts} == set(listed(path))
    one = read_text_index(spark, path).filter("job = 'job 3' AND seg = 31")
    assert [r.value for r in read_texts(spark, path, one).collect()] == [want["job 3", 31]]

    # a task that fails: the texts before it stay, and nothing of the run is left
    bad = df.withColumn("value", F.when(F.col("seg") == 200, F.raise_error("stop")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        write_text_packs(bad, path, ["job", "seg"], ["k"], files=20, partitions=3)
    assert {(r.job, r.seg): r.value for r in read_texts(spark, path).collect()} == want
    # another write replaces all, also what a lost attempt has left
    put(f"{path}/packs/lost-00000-1-0000.txt", "x")
    write_text_packs(df.filter("seg < 3"), path, ["job", "seg"], ["k"])
    assert {r.seg for r in read_texts(spark, path).collect()} == {0, 1, 2}
    assert not [f for f in os.listdir(f"{path}/packs") if f.startswith("lost")]
    write_text_packs(df.limit(0), path, ["job", "seg"], ["k"])
    assert listed(path) == [] and os.listdir(f"{path}/packs") == []


def test_write_timeline_keeps_the_old_one_when_it_fails(spark, tmp_path):
    path, chunks = f"{tmp_path}/line", spark.createDataFrame([(1,), (2,)], "i int")
    write_timeline(chunks, lambda stored: stored.filter("i = 1"), path)
    with pytest.raises(Exception, match="stop"):
        write_timeline(spark.createDataFrame([(3,)], "i int"), lambda stored: stored.select(F.raise_error("stop").alias("i")), path)
    assert spark.read.parquet(f"{path}/chunks").count() == 2 and spark.read.parquet(f"{path}/events").count() == 1
    new = write_timeline(spark.createDataFrame([(3,)], "i int"), chunks, path)
    assert [df.count() for df in new] == [1, 2]


# ---- the whole job ---------------------------------------------------------

def test_one_job_from_several_scripts(spark, tmp_path):
    one = put(f"{tmp_path}/z.txt", "STORY: Last name first\nOne. Two.\nSTORY: B\nThree.")
    two = put(f"{tmp_path}/a.txt", "STORY: C\nFour.\n\nFive. Six.")
    other = put(f"{tmp_path}/o.txt", "STORY: Other\nSeven.")

    def speak(batch):
        return pd.DataFrame({"sha": batch["sha"], "nbytes": batch["text"].str.len() * 2880})

    jobs = {"film": [one, two], "short": [other]}
    line = build_timeline(spark, jobs, speak, f"{tmp_path}/cache", f"{tmp_path}/out", "v")
    assert [(r.job_id, r.story_idx, r.title) for r in line.stories.orderBy("job_id", "story_idx").collect()] == [
        ("film", 0, "Last name first"), ("film", 1, "B"), ("film", 2, "C"), ("short", 0, "Other")]
    film = [r.text for r in line.events.filter("job_id = 'film'").orderBy("t0_ms").collect()]
    assert film == ["One.", "Two.", "Three.", "Four.", "Five.", "Six."]
    pool = spark.createDataFrame([(f"p:{i}", f"n{i}", 20.0) for i in range(9)], "key string, path string, duration_s double")
    plan = build_plan(line, pool, 45.0)
    assert {r.job_id for r in segment_captions(line, plan).collect()} == {"film", "short"}
    blank = put(f"{tmp_path}/blank.txt", " \n\n")
    with pytest.raises(ValueError, match="no stories found in .*blank.txt"):
        build_timeline(spark, {"film": [one, blank]}, speak, f"{tmp_path}/cache", f"{tmp_path}/out2", "v")


def test_build_captions_verify(spark, tmp_path):
    text = "\n\n".join(f"STORY: S{k}\n" + " ".join(f"This is sentence {i} of story {k}, said slowly." for i in range(12))
                       for k in range(6))
    script = put(f"{tmp_path}/s.txt", text)

    def speak(batch):
        return pd.DataFrame({"sha": batch["sha"], "nbytes": batch["text"].str.len() * 2880})

    line = build_timeline(spark, script, speak, f"{tmp_path}/cache", f"{tmp_path}/out", "v", 1.0, 2)
    total = line.summary.first()
    assert total.sentences == 72 and total.caption_events == line.events.count()
    pool = spark.createDataFrame([(f"p:{i}", f"n{i}", 20.0) for i in range(20)], "key string, path string, duration_s double")
    plan = build_plan(line, pool, 45.0, poses=["x.png", "y.png"]).cache()
    rows = plan.orderBy("idx").collect()
    assert rows[0].t0_ms == 0 and rows[-1].t1_ms == pytest.approx(total.total_ms)
    assert [r.pose for r in rows] == [("x.png", "y.png")[r.story_first % 2] for r in rows]
    clipped = segment_captions(line, plan).cache()
    assert clipped.count() == total.caption_events
    assert write_captions(clipped, f"{tmp_path}/ass", keys=["script_id"], title="T", segments=plan) == total.caption_events
    files = spark.read.text(f"{tmp_path}/ass", wholetext=True).collect()
    assert len(files) == len(rows)
    for r in files:
        stamps = [x.split(",")[1] for x in r.value.splitlines() if x.startswith("Dialogue: ")]
        assert r.value.startswith("[Script Info]\nTitle: T\n") and stamps == sorted(stamps)
    segs = plan.select("script_id", "idx", "dur_s", F.lit("done").alias("state"), F.lit("p").alias("path"))
    probes = segs.select("script_id", "idx", F.col("dur_s").alias("probe_s"))
    report, problems = verify(segs, probes, line.events, clipped, ["script_id"])
    assert report.first().ok and problems.count() == 0
    report, problems = verify(segs, probes, line.events, clipped.filter("seg_idx > 0"), ["script_id"])
    assert not report.first().ok and problems.first().scope == "captions"
    jobs = plan.select("script_id").distinct().union(spark.createDataFrame([("none",)], "script_id string"))
    totals = line.summary.select("script_id", "total_ms")
    finals = totals.select("script_id", F.lit("out/final").alias("path"), (F.col("total_ms") / 1000 + 0.3).alias("probe_s"))
    report, problems = verify(segs, probes, line.events, clipped, ["script_id"], jobs, totals, finals)
    assert {(r.scope, r.problem.split()[0]) for r in problems.collect()} == {("job", "not"), ("final", "duration")}
    row = report.filter("script_id <> 'none'").first()
    assert (row.segments_done, row.segments_planned, row.events, row.caption_lines, row.final) == (
        len(rows), len(rows), total.caption_events, total.caption_events, "out/final")


def test_shared_folder_is_the_one_the_cluster_names(spark):
    from types import SimpleNamespace

    from storyline.session import drop_stages, scratch_path, shared_dir
    assert shared_dir(spark) == shared_dir(spark)      # one folder per session where none is named
    cluster = SimpleNamespace(conf=SimpleNamespace(get={"spark.checkpoint.dir": "/shared/x"}.get))
    assert scratch_path(cluster, "t").startswith("/shared/x/t-")
    # on a cluster that names none, nothing is written to one machine's folder
    unnamed = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: other),
                              sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(unnamed)
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and drop_stages(spark) >= 1 and not os.path.exists(path)


def test_upsert_keeps_what_another_stream_wrote(spark, tmp_path):
    def run(name, rows):
        df = spark.createDataFrame(rows, "k string, v int")
        df.write.parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
        stream_upsert(stream, f"{tmp_path}/u", "k", f"{tmp_path}/{name}-state").awaitTermination()
        return {(r.k, r.v) for r in read_latest(spark, f"{tmp_path}/u", "k").collect()}
    assert run("a", [("a", 1), ("b", 1)]) == {("a", 1), ("b", 1)}
    assert run("b", [("b", 2), ("c", 1)]) == {("a", 1), ("b", 2), ("c", 1)}


def test_captions_in_folders_are_read_by_their_index(spark, tmp_path):
    """The same folders as Spark's writer makes, without moving or listing any of them in the driver."""
    rows = [(job, seg, i, float(i), i + 0.5, f"line {i}") for job in ("a", "b=c/d: 100%", None) for seg in range(4) for i in range(3 + seg)]
    df = spark.createDataFrame(rows, "job_id string, seg_idx int, id long, t0_ms double, t1_ms double, text string")
    for out in (df, df.filter("seg_idx < 2")):       # a second run replaces the first
        n = out.count()
        assert write_captions(out, f"{tmp_path}/ass", header="H {title}", title="T") == n
        lines = read_text_folders(spark, f"{tmp_path}/ass").collect()
        want = [(r.job_id, r.seg_idx, r.text) for r in out.collect()]
        assert sorted((str(r.job_id), r.seg_idx, r.value.rsplit(",", 1)[1]) for r in lines if r.value != "H T") == sorted(
            (str(j), s, t) for j, s, t in want)
        assert sum(r.value == "H T" for r in lines) == len({w[:2] for w in want})
        listed = spark.read.text(f"{tmp_path}/ass").collect()
        assert sorted((str(r.job_id), r.seg_idx, r.value) for r in listed) == sorted((str(r.job_id), r.seg_idx, r.value) for r in lines)
    write_captions(df.limit(0), f"{tmp_path}/none")
    assert read_text_folders(spark, f"{tmp_path}/none").collect() == []
    os.remove(f"{tmp_path}/ass/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        read_text_folders(spark, f"{tmp_path}/ass")


def test_stories_of_blocks_are_not_moved_for_their_numbers(spark, plan_of):
    lines = spark.createDataFrame([("f", b, i, t) for b in range(3) for i, t in enumerate(["STORY: one", "", "text", "---", "more"])],
                                  "file string, block long, at long, line string")
    stories = split_stories_blocks(lines, ["file"])
    plan = plan_of(stories)
    assert "Window" not in plan[:plan.index("Generate explode")]
    assert [(r.story_idx, r.title, r.paragraphs) for r in stories.orderBy("story_idx").collect()] == [
        (i, None if i % 2 else "one", ["more"] if i % 2 else ["text"]) for i in range(6)]


def test_lines_of_blocks_are_shuffled_once(spark):
    texts = ["\n".join(hashlib.sha256(f"{i} {at}".encode()).hexdigest() if at % 7 else ["STORY: one", "---", ""][at % 3]
                       for at in range(700)) for i in range(60)]
    lines = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "file int, text string").repartition(4).select(
        "file", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("block", F.floor(F.col("at") / 100))

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))
    start = shuffled()
    lines.write.format("noop").mode("overwrite").save()
    own = shuffled() - start
    split_stories_blocks(lines, ["file"]).write.format("noop").mode("overwrite").save()
    assert shuffled() - start - 2 * own < 1.6 * sum(map(len, texts))


def test_scripts_of_a_job_are_split_once(spark, plan_of):
    scripts = spark.createDataFrame([("j", i, f"s{i}", "STORY: a\nText.\nSTORY: b\nMore.") for i in range(2)],
                                    "job_id string, ord int, path string, text string")
    stories = job_stories(scripts)
    assert "Generate" not in plan_of(stories)
    assert [(r.story_idx, r.title) for r in stories.orderBy("story_idx").collect()] == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
