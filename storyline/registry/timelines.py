"""Checked queries: clock, events, segments, scenes, captions."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import (assign_round_robin, boundary_snap, card_events, clean_suffix_start,
                         conservation_check, job_summary, overlap_clip, plan_scenes,
                         plan_segments, shape_classify, tiling_check, timeline_chunks)
from ..operators.running import running_before
from ..operators.scenes import MULTIPLIERS
from ..session import cut_lineage, scratch_path
from ..sources import read_text_folders, read_texts, write_caption_packs, write_captions, write_timeline
from .base import query, table
from .texts import conv_units
from . import sql as S

JOB = ["conv_id"]
SEG_MAX_S = 60.0


def conv_chunks(spark, d):
    # written once: the clock reads block totals and rows, the text pass runs once
    return timeline_chunks(cut_lineage(conv_units(spark, d)), JOB, ("turn", "sent_idx"))


def conv_events(spark, d):
    return card_events(conv_chunks(spark, d), JOB, "turn")


def _timeline(spark, d):
    chunks = cut_lineage(conv_chunks(spark, d))
    events = card_events(chunks, JOB, "turn")
    return chunks, events, job_summary(chunks, events, JOB)


def conv_segments(spark, d):
    """Stored events of conversations, and their segments."""
    chunks = cut_lineage(conv_chunks(spark, d))
    events = cut_lineage(card_events(chunks, JOB, "turn"))
    totals = job_summary(chunks, events, JOB)
    return events, totals, plan_segments(events, totals, JOB, SEG_MAX_S, stage=False)


@query("timeline_chunks", f"""WITH RECURSIVE {S.conv_chunks()}
  SELECT conv_id, turn, s AS sent_idx, i, nbytes, sil AS silence_after_ms, nbytes / 48 AS dur_ms,
    t0b / 48 AS t0_ms, (t0b + nbytes) / 48 AS t1_ms, text FROM ch""")
def _timeline_chunks(spark, d):
    return conv_chunks(spark, d).select("conv_id", "turn", "sent_idx", "i", "nbytes", "silence_after_ms",
                                        "dur_ms", "t0_ms", "t1_ms", "text")


@query("card_events", f"""WITH RECURSIVE {S.conv_events()}
  SELECT conv_id, id, story, sentence, grp, text, t0_ms, t1_ms, story_end FROM ev""")
def _card_events(spark, d):
    return conv_events(spark, d)


@query("job_summary", f"""WITH RECURSIVE {S.conv_chunks()},
  t AS (SELECT conv_id, max(t0b + nbytes + 48 * sil) / 48 AS total_ms,
    sum(len(string_split(text, ' ')))::BIGINT AS words, count(*) AS sentences,
    sum(len(groups))::BIGINT AS caption_events FROM ch GROUP BY conv_id)
  SELECT conv_id, total_ms, words, sentences, caption_events,
    printf('%d:%02d:%02d', z // 3600, z // 60 % 60, z % 60) AS length
  FROM (SELECT *, floor(total_ms / 1000)::BIGINT AS z FROM t)""")
def _job_summary(spark, d):
    return _timeline(spark, d)[2]


@query("write_timeline", f"""WITH RECURSIVE {S.conv_events()}
  SELECT ev.conv_id, ev.id, ev.text, ev.t0_ms, ev.t1_ms, ev.story, ev.story_end, (SELECT count(*) FROM ch WHERE ch.conv_id = ev.conv_id) AS chunks
  FROM ev""")
def _write_timeline(spark, d):
    chunks, events = write_timeline(conv_chunks(spark, d), lambda stored: card_events(stored, JOB, "turn"),
                                    scratch_path(spark, "timeline"))
    return events.select("conv_id", "id", "text", "t0_ms", "t1_ms", "story", "story_end").join(
        chunks.groupBy(*JOB).agg(F.count(F.lit(1)).alias("chunks")), JOB)


@query("plan_segments", f"""WITH RECURSIVE {S.conv_segments(SEG_MAX_S * 1000)}
  SELECT conv_id, idx, t0_ms, t1_ms, story_first FROM seg""")
def _plan_segments(spark, d):
    return conv_segments(spark, d)[2]


# Customers share a hundred jobs and every order is an event, some of them longer
# than a segment may be; the jobs need many time blocks.
_LINES_SQL = """ln AS (SELECT o_custkey % 100 AS job, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS id,
  CASE WHEN o_orderstatus = 'F' THEN 400000 ELSE 1000 + o_custkey % 7 * 500 END AS ms,
  o_orderpriority = '5-LOW' AS story_end, o_orderkey AS story FROM orders),
ev AS (SELECT *, sum(ms) OVER (PARTITION BY job ORDER BY id)::DOUBLE AS t1_ms FROM ln),
tot AS (SELECT job, max(t1_ms) + 1200 AS total_ms FROM ev GROUP BY job),
st AS (SELECT job, id, t1_ms FROM ev UNION ALL SELECT job, -1, 0.0 FROM tot),
jump AS (SELECT s.job, s.id, coalesce(max(e.id) FILTER (e.story_end), max(e.id), s.id + 1) AS nxt
  FROM st s LEFT JOIN ev e ON e.job = s.job AND e.id > s.id AND e.t1_ms - s.t1_ms <= 30000 GROUP BY s.job, s.id),
walk AS (SELECT job, 0 AS idx, -1::BIGINT AS p, 0.0::DOUBLE AS t0 FROM tot UNION ALL
  SELECT w.job, w.idx + 1, j.nxt, e.t1_ms FROM walk w JOIN jump j ON j.job = w.job AND j.id = w.p
  JOIN ev e ON e.job = w.job AND e.id = j.nxt JOIN tot ON tot.job = w.job WHERE w.t0 < tot.total_ms - 1)
SELECT w.job, w.idx, w.t0 AS t0_ms, coalesce(e.t1_ms, tot.total_ms) AS t1_ms, coalesce(f.story, l.story) AS story_first
FROM walk w JOIN tot ON tot.job = w.job JOIN jump j ON j.job = w.job AND j.id = w.p
LEFT JOIN ev e ON e.job = w.job AND e.id = j.nxt LEFT JOIN ev f ON f.job = w.job AND f.id = w.p + 1
LEFT JOIN ev l ON l.job = w.job AND l.id = w.p WHERE w.t0 < tot.total_ms - 1"""


@query("plan_segments_long_jobs", "WITH RECURSIVE " + _LINES_SQL)
def _plan_segments_long(spark, d):
    from ..operators import running_before
    orders = table(spark, d, "orders")
    ms = F.when(F.col("o_orderstatus") == "F", 400000).otherwise(1000 + F.col("o_custkey") % 7 * 500)
    rows = orders.select((F.col("o_custkey") % 100).alias("job"), F.col("o_orderkey").alias("story"),
                         ms.cast("bigint").alias("ms"), (F.col("o_orderpriority") == "5-LOW").alias("story_end"))
    placed = running_before(rows, ["job"], [[F.floor(F.col("story") / 4096)], [F.col("story")]],
                            {"id": (F.lit(1), "bigint"), "t0": (F.col("ms"), "bigint")})
    events = placed.withColumn("t1_ms", (F.col("t0") + F.col("ms")).cast("double"))
    totals = events.groupBy("job").agg((F.max("t1_ms") + 1200).alias("total_ms"))
    return plan_segments(events, totals, ["job"], 30.0, span=64)


@query("boundary_snap", f"""WITH RECURSIVE {S.conv_segments(SEG_MAX_S * 1000)}
  SELECT conv_id, idx, ceil(t0_ms) AS t0_ms, floor(t1_ms) AS t1_ms FROM seg""")
def _boundary_snap(spark, d):
    return boundary_snap(conv_segments(spark, d)[2]).select("conv_id", "idx", "t0_ms", "t1_ms")


_CLIPPED = f"""{S.conv_segments(SEG_MAX_S * 1000)},
sn AS (SELECT conv_id, idx, ceil(t0_ms) AS s0, floor(t1_ms) AS s1 FROM seg),
cl AS (SELECT ev.conv_id, sn.idx AS seg_idx, ev.id, ev.text, greatest(t0_ms, s0) - s0 AS t0_ms,
    least(t1_ms, s1) - s0 AS t1_ms
  FROM ev JOIN sn ON sn.conv_id = ev.conv_id AND ev.t1_ms > s0 AND ev.t0_ms < s1)"""


def _clipped(spark, d):
    events, _, segments = conv_segments(spark, d)
    return events, segments, overlap_clip(events, boundary_snap(segments), JOB)


@query("overlap_clip", f"WITH RECURSIVE {_CLIPPED} SELECT conv_id, seg_idx, id, text, t0_ms, t1_ms FROM cl")
def _overlap_clip(spark, d):
    return _clipped(spark, d)[2].select("conv_id", "seg_idx", "id", "text", "t0_ms", "t1_ms")


@query("conservation_check", f"""WITH RECURSIVE {_CLIPPED}
  SELECT conv_id, e AS events, c AS captions FROM (
    SELECT ev.conv_id, count(*) AS e,
      (SELECT count(*) FROM cl WHERE cl.conv_id = ev.conv_id AND cl.seg_idx <> 1) AS c FROM ev GROUP BY ev.conv_id)
  WHERE e <> c""")
def _conservation_check(spark, d):
    # one segment's captions are left out, so that there is something to report
    events, segments, clipped = _clipped(spark, d)
    return conservation_check(events, clipped.filter("seg_idx <> 1"), JOB, segments)


def _stamp(ms: str) -> str:
    cs = f"round_even(greatest({ms}, 0) / 10, 0)::BIGINT"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


# All lines of every segment's text: eight of the head, then the events in order.
_CAPTIONS_SQL = rf"""{_CLIPPED},
  line AS (SELECT conv_id, seg_idx, id, 'Dialogue: 0,' || {_stamp("t0_ms")} || ',' || {_stamp("t1_ms")} || ',Narr,,0,0,0,,' ||
    replace(translate(text, '{{{{}}}}', '()'), chr(10), '\N') AS value FROM cl),
  head AS (SELECT DISTINCT conv_id, seg_idx, unnest([-8, -7, -6, -5, -4, -3, -2, -1]) AS id, unnest(string_split(
    '[Script Info]|Title: captions|ScriptType: v4.00+|PlayResX: 1920|PlayResY: 1080||[Events]|Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text',
    '|')) AS value FROM cl),
  captions AS (SELECT conv_id, seg_idx, row_number() OVER (PARTITION BY conv_id, seg_idx ORDER BY id) - 1 AS line_no, value
    FROM (SELECT * FROM line UNION ALL SELECT * FROM head))"""


@query("write_captions", f"WITH RECURSIVE {_CAPTIONS_SQL} SELECT conv_id, seg_idx, value, count(*) AS n, (SELECT count(*) FROM cl) AS reported "
       "FROM captions GROUP BY ALL")
def _write_captions(spark, d):
    path = scratch_path(spark, "captions")
    n = write_captions(_clipped(spark, d)[2], path, keys=JOB)
    return read_text_folders(spark, path).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("seg_idx").cast("bigint").alias("seg_idx"), "value").groupBy(
        "conv_id", "seg_idx", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("reported", F.lit(n).cast("bigint"))


@query("write_caption_packs", f"WITH RECURSIVE {_CAPTIONS_SQL} SELECT conv_id, seg_idx, line_no, value FROM captions")
def _write_caption_packs(spark, d):
    path = scratch_path(spark, "captions")
    write_caption_packs(_clipped(spark, d)[2], path, keys=JOB, files=50)
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return read_texts(spark, path).select("conv_id", "seg_idx", F.posexplode(lines).alias("line_no", "value"))


@query("overlap_clip_open_end", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 - epoch_us(date_trunc('month', ts)) // 1000 AS t0 FROM events)
  SELECT user_id, event_id, CASE WHEN t0 < 864000000 THEN 0 ELSE 1 END AS seg_idx,
    CASE WHEN t0 < 864000000 THEN t0 ELSE t0 - 864000000 END::DOUBLE AS t0_ms,
    CASE WHEN t0 < 864000000 THEN least(t0 + 1000, 864000000) ELSE t0 + 1000 - 864000000 END::DOUBLE AS t1_ms FROM e
  UNION ALL SELECT user_id, event_id, 1, 0.0, (t0 + 1000 - 864000000)::DOUBLE FROM e WHERE t0 < 864000000 AND t0 + 1000 > 864000000""")
def _overlap_clip_open_end(spark, d):
    # the clock of a month; the second segment has no end and gets what lies days after its start
    ev = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    t0 = (F.unix_millis(ts) - F.unix_millis(F.date_trunc("month", ts))).cast("double")
    events = ev.select("user_id", "event_id", t0.alias("t0_ms"), (t0 + 1000).alias("t1_ms"))
    ends = F.array(F.struct(F.lit(0).alias("idx"), F.lit(0.0).alias("t0_ms"), F.lit(864e6).alias("t1_ms")),
                   F.struct(F.lit(1).alias("idx"), F.lit(864e6).alias("t0_ms"), F.lit(None).cast("double").alias("t1_ms")))
    segments = ev.select("user_id").distinct().withColumn("s", F.explode(ends)).select("user_id", "s.*")
    return overlap_clip(events, segments, ["user_id"], bucket_ms=3_600_000)


@query("running_before_null_positions", """SELECT o_custkey, o_orderkey, coalesce(sum(o_custkey % 5 + 1) OVER (
    PARTITION BY CASE WHEN o_custkey % 10 > 0 THEN o_custkey END
    ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey // 1000 END NULLS LAST, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders""")
def _running_before_null_positions(spark, d):
    # null keys are one key, null positions come last; no row is lost
    orders = table(spark, d, "orders").withColumn("key", F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")))
    block = F.when(F.col("o_orderkey") % 7 > 0, F.floor(F.col("o_orderkey") / 1000))
    out = running_before(orders, ["key"], [[block], [F.col("o_orderkey")]],
                         {"before": (F.col("o_custkey") % 5 + 1, "bigint")})
    return out.select("o_custkey", "o_orderkey", "before")


@query("tiling_check", f"""WITH RECURSIVE {S.conv_segments(SEG_MAX_S * 1000)},
  bad AS (SELECT conv_id, idx, CASE WHEN idx = 2 THEN t0_ms + 500 ELSE t0_ms END AS t0_ms, t1_ms FROM seg)
  SELECT b.conv_id, b.idx, 'gap or overlap' AS problem, p.t1_ms AS want, b.t0_ms AS got
  FROM bad b JOIN bad p ON p.conv_id = b.conv_id AND p.idx = b.idx - 1 WHERE p.t1_ms <> b.t0_ms""")
def _tiling_check(spark, d):
    # the third segment of each job is shifted, so that there is something to report
    _, totals, segments = conv_segments(spark, d)
    shifted = segments.withColumn("t0_ms", F.when(F.col("idx") == 2, F.col("t0_ms") + 500).otherwise(F.col("t0_ms")))
    return tiling_check(shifted, totals, JOB)


def _pool(spark, d):
    return table(spark, d, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"),
        F.concat(F.lit("norm/"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_size").cast("double").alias("duration_s"))


def _scenes(spark, d):
    return plan_scenes(conv_segments(spark, d)[2], _pool(spark, d), JOB)


def _pick(n: str) -> str:
    """The place of a job's scene number ``n`` among ``dims.size`` clips in ``dims.groups`` groups."""
    q = f"({n} % size)"
    group = f"((({q} + 1) * groups - 1) // size)"
    low, high = f"({group} * size // groups)", f"(({group} + 1) * size // groups)"
    drawn = S.draw(f"'1234|' || conv_id || '|' || ({n} // size) || '|' || {group} || '|order'")
    return f"({low} + (({q} - {low}) * multipliers[{drawn} % 16 + 1] + {drawn} // 16) % ({high} - {low}))"


# A job takes all clips in a drawn order, then all in another; a scene ends with its draw, its clip or its segment.
_SCENES = f"""{S.conv_segments(SEG_MAX_S * 1000)},
  clip AS (SELECT 'part:' || q.p_partkey AS key, 'norm/' || q.p_partkey AS path, q.p_size * 1000 AS ms,
    row_number() OVER (ORDER BY sha256('1234|part:' || q.p_partkey)) - 1 AS place FROM main.part AS q),
  dims AS (SELECT count(*) AS size, CASE WHEN count(*) < 8 THEN 1 ELSE (2 * count(*) - 7) // (count(*) - 6) END AS groups,
    {list(MULTIPLIERS)}::BIGINT[] AS multipliers FROM clip),
  long AS (SELECT *, t1_ms - t0_ms AS len, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS s
    FROM seg WHERE t1_ms - t0_ms >= 50),
  step AS (
    SELECT conv_id, s, 0 AS n, 0 AS scene, 0.0::DOUBLE AS start, -1::BIGINT AS place, 0.0::DOUBLE AS lasts FROM long WHERE s = 1
    UNION ALL
    SELECT t.conv_id, t.s, t.n + 1, t.scene + 1, t.start, c.place,
      least(8000 + {S.draw("'1234|' || t.conv_id || '|' || t.n")} % 8001, c.ms)::DOUBLE
    FROM (SELECT *, {_pick("n")} AS pick FROM (
        SELECT p.conv_id, l.s, p.n, CASE WHEN l.s = p.s THEN p.scene ELSE 0 END AS scene,
          CASE WHEN l.s = p.s THEN p.start + p.lasts ELSE 0 END AS start
        FROM step p JOIN long o ON o.conv_id = p.conv_id AND o.s = p.s
        JOIN long l ON l.conv_id = p.conv_id
          AND l.s = CASE WHEN o.len - (p.start + p.lasts) < 50 THEN p.s + 1 ELSE p.s END), dims) t
    JOIN clip c ON c.place = t.pick),
  slot AS (SELECT conv_id, s, scene - 1 AS scene, place,
      coalesce(lead(start) OVER (PARTITION BY conv_id, s ORDER BY scene), len) - start AS dur, idx
    FROM step JOIN long USING (conv_id, s) WHERE n > 0),
  scene AS (SELECT conv_id, idx, scene, key, path, CASE WHEN ms - ceil(dur) > 1000
      THEN {S.draw("'1234|' || conv_id || '|' || idx || '|' || scene || '|in'")} % (ms - ceil(dur)::BIGINT + 1) / 1000.0
      ELSE 0.0 END AS in_s, round(dur / 1000.0, 3) AS dur_s
    FROM slot JOIN clip USING (place))"""


@query("plan_scenes", f"WITH RECURSIVE {_SCENES} SELECT * FROM scene")
def _plan_scenes(spark, d):
    return _scenes(spark, d).select("conv_id", "idx", F.posexplode("scenes").alias("scene", "s")).select(
        "conv_id", "idx", "scene", "s.key", "s.path", "s.in_s", "s.dur_s")


@query("plan_scenes_invariants", f"""WITH RECURSIVE {S.conv_segments(SEG_MAX_S * 1000)}
  SELECT conv_id, idx, true AS sum_exact, true AS in_band, true AS clip_long_enough, true AS no_repeat_in_seven,
    t1_ms - t0_ms >= 50 AS filled FROM seg""")
def _plan_scenes_invariants(spark, d):
    return scene_invariants(_scenes(spark, d), table(spark, d, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), "p_size"))


def scene_invariants(rows, parts):
    """What holds for the scenes of every segment; ``parts(key, p_size)`` are the lengths of the clips."""
    total = F.aggregate("scenes", F.lit(0.0), lambda a, s: a + s.dur_s)
    one = rows.select("conv_id", "idx", F.posexplode("scenes").alias("pos", "s"), F.size("scenes").alias("n"))
    # the same clip in the six picks before, over the whole job
    last = Window.partitionBy("conv_id").orderBy("idx", "pos").rowsBetween(-6, -1)
    one = one.withColumn("recent", F.array_contains(F.collect_list("s.key").over(last), F.col("s.key")))
    # the last scene also takes what is left below 0.05 s
    spare = F.when(F.col("pos") == F.col("n") - 1, 0.05).otherwise(0.001)
    one = one.withColumn("key", F.col("s.key")).join(parts, "key").groupBy("conv_id", "idx").agg(
        F.bool_and((F.col("s.dur_s") <= 16.0 + spare) & ((F.col("s.dur_s") >= F.least(F.lit(8), "p_size"))
                                                         | (F.col("pos") == F.col("n") - 1))
                   & (F.col("s.dur_s") >= 0.05)).alias("in_band"),
        F.bool_and(F.col("s.dur_s") + F.col("s.in_s") <= F.col("p_size") + spare).alias("clip_long_enough"),
        F.bool_and(~F.col("recent")).alias("no_repeat_in_seven"))
    return rows.select(
        "conv_id", "idx", (F.abs(total - (F.col("t1_ms") - F.col("t0_ms")) / 1000.0) <= 0.001).alias("sum_exact"),
        (F.size("scenes") > 0).alias("filled")).join(one, ["conv_id", "idx"], "left").select(
        "conv_id", "idx", "sum_exact", *[F.coalesce(c, F.lit(True)).alias(c) for c in
                                         ("in_band", "clip_long_enough", "no_repeat_in_seven")], "filled")


@query("assign_round_robin", f"""WITH RECURSIVE {S.conv_segments(SEG_MAX_S * 1000)}
  SELECT conv_id, idx, story_first, n_name AS resource FROM seg
  LEFT JOIN nation ON n_nationkey = story_first % (SELECT count(*) FROM nation)""")
def _assign_round_robin(spark, d):
    poses = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value"))
    return assign_round_robin(conv_segments(spark, d)[2], "story_first", poses).select(
        "conv_id", "idx", "story_first", "resource")


# ---- samples: a user's events in five slices of the month ------------------

def _slices(spark, d):
    ev = table(spark, d, "events")
    slot = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4)).cast("int")
    per = ev.groupBy("user_id", slot.alias("slot")).agg(F.count_if(F.col("event_type") == "error").alias("bad"))
    return per.select("user_id", "slot", F.when(F.col("bad") > 1, 1440).otherwise(1920).alias("w"),
                      F.lit(1080).alias("h"), F.when(F.col("bad") > 1, 240).otherwise(0).alias("x"), F.lit(0).alias("y"))


@query("shape_classify", """WITH sl AS (SELECT user_id, least((day(ts) - 1) // 6, 4) AS slot,
    CASE WHEN count(*) FILTER (event_type = 'error') > 1 THEN 1440 ELSE 1920 END AS w FROM events GROUP BY ALL),
  f AS (SELECT user_id, count(*) AS n, list(w = 1920 ORDER BY slot) AS l FROM sl GROUP BY user_id),
  c AS (SELECT user_id, count(*)::DOUBLE AS dur, count(*) * (user_id % 10) / 10.0 AS trim FROM events GROUP BY user_id),
  k AS (SELECT c.user_id, dur, trim, CASE WHEN dur < 3 OR n < 5 THEN 'none'
      WHEN NOT list_bool_or(l) THEN 'static' WHEN NOT l[1] AND l[4] AND l[5] AND trim <= dur * 0.75 THEN 'dynamic'
      ELSE 'none' END AS kind FROM c JOIN f ON f.user_id = c.user_id)
  SELECT user_id, kind, CASE WHEN kind = 'static' THEN 1440 END AS w, CASE WHEN kind = 'static' THEN 1080 END AS h,
    CASE WHEN kind = 'static' THEN 240 END AS x, CASE WHEN kind = 'static' THEN 0 END AS y,
    CASE WHEN kind = 'dynamic' THEN trim ELSE 0.0 END AS trim_s FROM k""")
def _shape_classify(spark, d):
    clips = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("dur_s"))
    clips = clips.withColumn("trim_s", F.col("dur_s") * (F.col("user_id") % 10) / 10.0)
    return shape_classify(_slices(spark, d), clips, "user_id")


@query("clean_suffix_start", """WITH s AS (SELECT user_id, event_type <> 'error' AS f,
    ((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS t FROM events),
  b AS (SELECT user_id, max(t) FILTER (NOT f) AS bad, max(t) + 1 AS dur FROM s GROUP BY user_id)
  SELECT b.user_id, CASE WHEN bad IS NULL OR bad < dur - 86400 THEN
    (SELECT min(t) FROM s WHERE s.user_id = b.user_id AND (bad IS NULL OR s.t > bad)) END AS trim_s FROM b""")
def _clean_suffix_start(spark, d):
    t = (F.dayofmonth("ts") - 1) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = table(spark, d, "events").select("user_id", t.cast("double").alias("t"),
                                            (F.col("event_type") != "error").alias("f"))
    clips = rows.groupBy("user_id").agg((F.max("t") + 1).alias("dur_s"))
    return clean_suffix_start(rows, clips, "user_id", full=F.col("f"), tail_s=86400.0)
