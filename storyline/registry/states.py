"""Checked queries: merging, job state, enrichment, quality, streams."""
from __future__ import annotations

import os

from pyspark.sql import Window, functions as F

from ..functions import content_key
from ..functions.text import clean_text
from ..operators import (cached_enrich, carry_status, demote_stale, duration_check, job_board,
                         final_problems, job_problems, job_report, job_totals, merge_records, not_built, patch_fields, progress,
                         progress_stats, resume_filter, segment_problems, sentences, status_counts)
from ..session import scratch_path
from ..sources import parse_job_state, read_log
from ..streaming import (checkpoint_merge, compact, read_latest, read_progress, stream_first_seen,
                         stream_progress, stream_tail, stream_upsert)
from .base import BYTES_PER_CHAR, query, table, texts
from . import sql as S

# ---- merging ---------------------------------------------------------------


@query("merge_records", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey, 'new', o_totalprice + 1 FROM orders WHERE o_orderstatus = 'F'""")
def _merge_records(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    incoming = orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", F.lit("new").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge_records(orders, incoming, "o_orderkey")


@query("patch_fields", """SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderpriority = '5-LOW' THEN 'kept?' ELSE '' END AS term,
    CASE WHEN o_orderpriority = '5-LOW' THEN 7.5 ELSE o_totalprice END AS duration_s FROM orders""")
def _patch_fields(spark, d):
    orders = table(spark, d, "orders")
    target = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
                           .alias("term"), F.col("o_totalprice").alias("duration_s"))
    patch = orders.filter("o_orderpriority = '5-LOW'").select(
        "o_orderkey", F.lit("kept?").alias("term"), F.lit(7.5).alias("duration_s"))
    return patch_fields(target, patch, "o_orderkey", keep=("term",))


# ---- job state: an order is a job, its line numbers are its segments -------

_SEGS_SQL = """sg AS (SELECT l_orderkey AS job, l_linenumber AS idx, sum(l_quantity) AS dur_s,
    CASE WHEN max(l_linestatus) = 'F' THEN 'done' WHEN max(l_returnflag) = 'R' THEN NULL ELSE 'rendering' END AS state,
    CASE WHEN max(l_discount) > 0.02 THEN 'seg/' || min(l_partkey) END AS path FROM lineitem GROUP BY ALL),
  pr AS (SELECT l_orderkey AS job, l_linenumber AS idx, sum(l_quantity) + CASE WHEN max(l_tax) > 0.07 THEN 0.25 ELSE 0.125 END
    AS probe_s FROM lineitem GROUP BY ALL HAVING min(l_suppkey) > 10)"""


def _segments(spark, d):
    open_lines = F.count_if(F.col("l_linestatus") == "O")
    returned = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx")).agg(
        F.sum("l_quantity").alias("dur_s"),
        F.when(open_lines == 0, "done").when(returned > 0, None).otherwise("rendering").alias("state"),
        F.when(F.max("l_discount") > 0.02, F.concat(F.lit("seg/"), F.min("l_partkey").cast("string"))).alias("path"))


def _probes(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx")).agg(
        (F.sum("l_quantity") + F.when(F.max("l_tax") > 0.07, 0.25).otherwise(0.125)).alias("probe_s"),
        F.min("l_suppkey").alias("s")).filter("s > 10").drop("s")


@query("carry_status", f"""WITH {_SEGS_SQL}, plan AS (SELECT l_orderkey AS job, l_linenumber AS idx FROM lineitem)
  SELECT plan.job, plan.idx, coalesce(sg.state, 'pending') AS state, sg.path,
    CASE WHEN sg.state = 'done' THEN 'none' END AS problems
  FROM plan LEFT JOIN sg ON sg.job = plan.job AND sg.idx = plan.idx""")
def _carry_status(spark, d):
    plan = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx"))
    old = _segments(spark, d).withColumn("problems", F.when(F.col("state") == "done", "none"))
    return carry_status(plan, old, ["job", "idx"])


@query("demote_stale", f"""WITH {_SEGS_SQL}, j AS (SELECT sg.*, state IS NOT DISTINCT FROM 'done'
    AND NOT (coalesce(abs(probe_s - dur_s) <= 0.15, false) AND path IS NOT NULL) AS demoted
    FROM sg LEFT JOIN pr ON pr.job = sg.job AND pr.idx = sg.idx)
  SELECT job, idx, dur_s, CASE WHEN demoted THEN 'pending' ELSE state END AS state,
    CASE WHEN NOT demoted THEN path END AS path, demoted FROM j""")
def _demote_stale(spark, d):
    return demote_stale(_segments(spark, d), _probes(spark, d), ["job", "idx"])


@query("status_counts", f"""WITH {_SEGS_SQL} SELECT coalesce(state, 'pending') AS state, count(*) AS n FROM sg GROUP BY ALL""")
def _status_counts(spark, d):
    return status_counts(_segments(spark, d))


_PROGRESS_SQL = f"""{_SEGS_SQL}, ph AS (SELECT o_orderkey AS job, o_orderstatus <> 'O' AS tl, o_orderpriority = '1-URGENT' AS cc FROM orders
    WHERE o_orderstatus <> 'P'),
  ct AS (SELECT job, count(*) AS total, count(*) FILTER (state = 'done') AS done,
    count(*) FILTER (state IS NULL) AS pending FROM sg GROUP BY job),
  pg AS (SELECT coalesce(ph.job, ct.job) AS job, (CASE WHEN cc THEN 'concat' ELSE '' END) || (CASE WHEN cc AND tl THEN ',' ELSE '' END)
      || (CASE WHEN tl THEN 'timeline' ELSE '' END) AS phases_done, coalesce(total, 0) AS segments_total,
    coalesce(done, 0) AS done, coalesce(pending, 0) AS pending,
    CASE WHEN cc THEN 1.0 WHEN coalesce(total, 0) > 0 THEN round_even(done / total, 4) ELSE 0.0 END::DOUBLE AS progress
    FROM ph FULL JOIN ct ON ct.job = ph.job)"""


def _phases(spark, d):
    # orders in part have no phases, only segments
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return orders.select(F.col("o_orderkey").alias("job"), F.explode(F.array(
        F.struct(F.lit("timeline").alias("phase"), (F.col("o_orderstatus") != "O").alias("done")),
        F.struct(F.lit("concat").alias("phase"), (F.col("o_orderpriority") == "1-URGENT").alias("done")))).alias("p")
    ).select("job", "p.phase", "p.done")


def _progress_rows(spark, d):
    return progress(_phases(spark, d), _segments(spark, d), ["job"])


def _flat(rows):
    def n(state):
        return F.coalesce(F.try_element_at("segments", F.lit(state)), F.lit(0))
    return rows.withColumns({"phases_done": F.array_join("phases_done", ","), "done": n("done"), "pending": n("pending")})


@query("progress", f"WITH {_PROGRESS_SQL} SELECT job, phases_done, segments_total, done, pending, progress FROM pg")
def _progress(spark, d):
    return _flat(_progress_rows(spark, d)).select("job", "phases_done", "segments_total", "done", "pending", "progress")


@query("job_board", f"""WITH {_PROGRESS_SQL} SELECT job, progress, epoch_ms(o_orderdate) // 86400000 AS updated_day,
    CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS size
  FROM pg JOIN orders ON o_orderkey = job ORDER BY o_orderdate DESC, job""")
def _job_board(spark, d):
    out = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("updated"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("size"))
    board = job_board(_progress_rows(spark, d), out, ["job"])
    return board.select("job", "progress", F.unix_date(F.to_date("updated")).cast("bigint").alias("updated_day"), "size")


@query("resume_filter", f"""WITH {_SEGS_SQL} SELECT l_orderkey AS job, l_linenumber AS idx FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.job = l_orderkey AND sg.idx = l_linenumber AND state = 'done' AND path IS NOT NULL)""")
def _resume_filter(spark, d):
    work = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx"))
    done = _segments(spark, d).select("job", "idx", "state", F.col("path").alias("output"),
                                      F.lit("h1").alias("params_hash"))
    return resume_filter(work, done, "h1", ["job", "idx"])


@query("read_job_state", """SELECT o_orderkey AS job, idx, CASE WHEN idx = 0 THEN o_orderstatus END AS state,
  (idx * 9000)::DOUBLE AS t0_ms, o_orderpriority = '1-URGENT' AS concat_done
  FROM (SELECT *, unnest([0, 1]) AS idx FROM orders)""")
def _read_job_state(spark, d):
    orders = table(spark, d, "orders")

    def segment(i, state):
        return F.struct(F.lit(i).alias("idx"), F.lit(i * 9000.0).alias("t0_ms"), state.alias("state"))

    state = F.to_json(F.struct(
        F.create_map(F.lit("concat"), F.struct((F.col("o_orderpriority") == "1-URGENT").alias("done"))).alias("phases"),
        F.array(segment(0, F.col("o_orderstatus")), segment(1, F.lit(None).cast("string"))).alias("segments")))
    texts = orders.select(F.col("o_orderkey").alias("job"), state.alias("value"))
    texts = texts.unionByName(orders.select(F.col("o_orderkey").alias("job"), F.lit("{broken").alias("value")))
    phases, segments = parse_job_state(texts, "value", ["job"])
    done = phases.select("job", F.col("done").alias("concat_done"))
    return segments.join(done, "job").select("job", "idx", "state", "t0_ms", "concat_done")


# ---- logs ------------------------------------------------------------------

_LOG_SQL = """SELECT strftime(ts, '%H:%M:%S') AS time, CASE WHEN event_type = 'signup' THEN '---- session ----'
    ELSE event_type || ' ' || event_id END AS message, event_type = 'signup' AS is_session
  FROM events WHERE event_type <> 'error' UNION ALL SELECT NULL, 'error ' || event_id, false FROM events
  WHERE event_type = 'error'"""


def _log_values(events):
    kind = F.col("event_type")
    text = F.concat(kind, F.lit(" "), F.col("event_id").cast("string"))
    stamped = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "),
                       F.when(kind == "signup", "---- session ----").otherwise(text))
    return events.select("event_id", F.when(kind == "error", text).otherwise(stamped).alias("value"))


def _log_lines(spark, d):
    path = scratch_path(spark, "log")
    _log_values(table(spark, d, "events")).select("value").write.text(path)
    return path


@query("read_log", _LOG_SQL)
def _read_log(spark, d):
    return read_log(spark, _log_lines(spark, d)).select("time", "message", "is_session")


def _append_lines(folder):
    def append(key, rows):
        with open(f"{folder}/{key[0]}.log", "a", encoding="utf-8", newline="") as log:
            log.writelines(line + "\n" for line in rows.sort_values("event_id")["value"])
        return rows[["file"]].head(1)
    return append


@query("read_log_numbered", f"""SELECT event_id % 4 AS file, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS line_no,
  time, message, is_session FROM ({_LOG_SQL.replace("SELECT", "SELECT event_id,", 1).replace("UNION ALL SELECT", "UNION ALL SELECT event_id,", 1)})""")
def _read_log_numbered(spark, d):
    path = scratch_path(spark, "log")
    lines = _log_values(table(spark, d, "events")).withColumn("file", F.col("event_id") % 4)
    lines.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    file = F.regexp_extract("path", r"file=(\d)/", 1).cast("long").alias("file")
    return read_log(spark, f"{path}/*", numbered=True).select(file, "line_no", "time", "message", "is_session")


@query("stream_tail", f"""SELECT event_id % 4 AS file, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id % 3, event_id) AS line_no,
  time, message, is_session FROM ({_LOG_SQL.replace("SELECT", "SELECT event_id,", 1).replace("UNION ALL SELECT", "UNION ALL SELECT event_id,", 1)})""")
def _stream_tail(spark, d):
    # four files that grow twice; the stream is stopped and started again each time
    folder, out = scratch_path(spark, "log"), scratch_path(spark, "tail")
    state, positions = scratch_path(spark, "state"), scratch_path(spark, "positions")
    os.makedirs(folder)
    lines = _log_values(table(spark, d, "events")).withColumn("file", F.col("event_id") % 4)
    for part in range(3):
        lines.filter(F.col("event_id") % 3 == part).groupBy("file").applyInPandas(_append_lines(folder), "file long").count()
        query = stream_tail(spark, folder, positions).writeStream.format("parquet").option("checkpointLocation", state).start(out)
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(out).withColumn("file", F.regexp_extract("path", r"(\d)\.log$", 1).cast("long"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("line_no"),
                       "time", "message", "is_session")


# ---- enrichment ------------------------------------------------------------

def _measure(batch):
    out = batch[["sha"]].copy()
    out["nbytes"] = batch["text"].str.len() * BYTES_PER_CHAR
    return out


_ENRICH_SQL = f"""WITH c AS (SELECT conv_id, turn, {S.clean('text')} AS text FROM conversations),
  {S.sentences('c', 'conv_id, turn', 'text')},
  e AS (SELECT conv_id, turn, k AS sent_idx, text, 2880 * length(text) AS nbytes,
    row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, k) > 1 AS was_cached FROM sent)"""


def enrich_conversations(spark, d, cache):
    turns = texts(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", clean_text("text").alias("text"))
    rows = sentences(turns, ["conv_id", "turn"], "text")
    rows = rows.withColumn("sha", content_key("text", F.lit("voice")))
    return cached_enrich(rows, "sha", _measure, "nbytes bigint", cache,
                         inputs=["text"], ord=["conv_id", "turn", "sent_idx"])


def _enriched(spark, d):
    return enrich_conversations(spark, d, scratch_path(spark, "cache"))


@query("cached_enrich", f"{_ENRICH_SQL} SELECT * FROM e")
def _cached_enrich(spark, d):
    return _enriched(spark, d).drop("sha")


@query("progress_stats", f"""{_ENRICH_SQL} SELECT conv_id, count(*) AS done, count(*) FILTER (was_cached) AS cached,
  count(*) FILTER (NOT was_cached) AS net, count(*) / 8.0::DOUBLE AS rate, 0.0 AS eta_s FROM e GROUP BY conv_id""")
def _progress_stats(spark, d):
    return progress_stats(_enriched(spark, d), elapsed_s=8.0, keys=["conv_id"])


# ---- quality ---------------------------------------------------------------

@query("duration_check", f"""WITH {_SEGS_SQL} SELECT sg.job, sg.idx, abs(probe_s - dur_s) AS off_s
  FROM sg LEFT JOIN pr ON pr.job = sg.job AND pr.idx = sg.idx WHERE probe_s IS NULL OR abs(probe_s - dur_s) > 0.15""")
def _duration_check(spark, d):
    both = _segments(spark, d).join(_probes(spark, d), ["job", "idx"], "left")
    return duration_check(both, 0.15, "probe_s", "dur_s").select("job", "idx", "off_s")


_PROBLEMS_SQL = f"""{_SEGS_SQL}, j AS (SELECT sg.*, probe_s FROM sg LEFT JOIN pr ON pr.job = sg.job AND pr.idx = sg.idx),
  pb AS (SELECT job, 'segment ' || idx AS scope, 'state=' || coalesce(state, 'null') AS problem FROM j
      WHERE state IS DISTINCT FROM 'done'
    UNION ALL SELECT job, 'segment ' || idx, 'file missing' FROM j WHERE state = 'done' AND path IS NULL
    UNION ALL SELECT job, 'segment ' || idx, 'probe failed' FROM j WHERE state = 'done' AND path <> '' AND probe_s IS NULL
    UNION ALL SELECT job, 'segment ' || idx, printf('duration %.2f vs plan %.2f', probe_s, dur_s) FROM j
      WHERE state = 'done' AND path <> '' AND abs(probe_s - dur_s) > 0.15
    UNION ALL SELECT l_orderkey, 'order', 'no such order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
      WHERE o_orderstatus <> 'P') GROUP BY ALL)"""


def _problems(spark, d):
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job"))
    lost = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job")).distinct().join(
        orders, "job", "left_anti").select("job", F.lit("order").alias("scope"), F.lit("no such order").alias("problem"))
    return job_problems(segment_problems(_segments(spark, d), _probes(spark, d), ["job"], 0.15), lost)


@query("job_problems", f"WITH {_PROBLEMS_SQL} SELECT * FROM pb")
def _job_problems(spark, d):
    return _problems(spark, d)


@query("job_report", f"""WITH {_PROBLEMS_SQL} SELECT o_orderkey AS job, count(problem) = 0 AS ok, count(problem) AS n_problems,
  min(scope || ': ' || problem) AS first_problem FROM orders LEFT JOIN pb ON pb.job = o_orderkey GROUP BY o_orderkey""")
def _job_report(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"))
    return job_report(jobs, _problems(spark, d), ["job"])


def _jobs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"))


def _lines(spark, d, condition):
    return table(spark, d, "lineitem").filter(condition).select(F.col("l_orderkey").alias("job"))


@query("not_built", """SELECT o_orderkey AS job, 'job' AS scope, 'not a built job' AS problem FROM orders
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.05)""")
def _not_built(spark, d):
    return not_built(_jobs(spark, d), _segments(spark, d), _lines(spark, d, "l_tax > 0.05"), ["job"])


_FINALS_SQL = """tot AS (SELECT l_orderkey AS job, sum(l_quantity) AS planned FROM lineitem GROUP BY ALL),
  fin AS (SELECT o_orderkey AS job, 'out/' || o_orderkey AS path, CASE WHEN o_orderkey % 11 > 0
    THEN planned + o_orderkey % 3 * 0.2 END AS probe_s FROM orders LEFT JOIN tot ON tot.job = o_orderkey
    WHERE o_orderpriority = '1-URGENT')"""


def _totals(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(
        (F.sum("l_quantity") * 1000).alias("total_ms"))


def _finals(spark, d):
    job = F.col("o_orderkey")
    orders = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(
        _totals(spark, d), F.col("job") == job, "left")
    return orders.select(job.alias("job"), F.concat(F.lit("out/"), job.cast("string")).alias("path"), F.when(
        job % 11 > 0, F.col("total_ms") / 1000 + job % 3 * F.lit(0.2)).alias("probe_s"))


@query("final_problems", f"""WITH {_FINALS_SQL} SELECT fin.job, 'final' AS scope, CASE WHEN probe_s IS NULL
    THEN 'missing: ' || path ELSE printf('duration %.2f vs planned %.2f', probe_s, planned) END AS problem
  FROM fin LEFT JOIN tot ON tot.job = fin.job WHERE probe_s IS NULL OR abs(probe_s - planned) > 0.25""")
def _final_problems(spark, d):
    return final_problems(_finals(spark, d), _totals(spark, d), ["job"])


@query("job_totals", f"""WITH {_SEGS_SQL}, {_FINALS_SQL},
  s AS (SELECT job, count(*) AS planned, count(*) FILTER (state = 'done' AND path <> '') AS done FROM sg GROUP BY job),
  l AS (SELECT l_orderkey AS job, count(*) AS n, count(*) FILTER (l_tax > 0.05) AS c FROM lineitem GROUP BY ALL)
  SELECT o_orderkey AS job, coalesce(s.done, 0) AS segments_done, coalesce(s.planned, 0) AS segments_planned,
    coalesce(l.n, 0) AS events, coalesce(l.c, 0) AS caption_lines, fin.path AS final, round(tot.planned / 3600, 3) AS hours
  FROM orders LEFT JOIN s ON s.job = o_orderkey LEFT JOIN l ON l.job = o_orderkey LEFT JOIN tot ON tot.job = o_orderkey
  LEFT JOIN fin ON fin.job = o_orderkey""")
def _job_totals(spark, d):
    return job_totals(_jobs(spark, d), _segments(spark, d), _lines(spark, d, "true"), _lines(spark, d, "l_tax > 0.05"),
                      _totals(spark, d), _finals(spark, d), ["job"])


# ---- streams ---------------------------------------------------------------

def _event_stream(spark, d, **options):
    # a pattern, because the file source takes a folder or a pattern only
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{d}/[e]vents.parquet")


@query("stream_first_seen", """SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id,
  arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def _stream_first_seen(spark, d):
    # three batches, each over the whole time, and one row that closes it
    source, out = scratch_path(spark, "parts"), scratch_path(spark, "first")
    events = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    for part in (2, 0, 1):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(
        F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), "ts",
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    closing.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn(
        "key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    (stream_first_seen(stream, "key", "ts", "400 days", order=["event_id"]).writeStream.format("parquet")
     .option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
     .start(out).awaitTermination())
    return spark.read.parquet(out).filter("user_id IS NOT NULL").select(
        "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")


@query("stream_first_to_arrive", "SELECT DISTINCT user_id, event_type FROM events")
def _stream_first_to_arrive(spark, d):
    out = scratch_path(spark, "first")
    stream = _event_stream(spark, d).select(
        "user_id", "event_type", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    (stream_first_seen(stream, "key", unbounded=True).writeStream.format("parquet")
     .option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True)
     .start(out).awaitTermination())
    return spark.read.parquet(out).select("user_id", "event_type")


@query("stream_upsert", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def _stream_upsert(spark, d):
    target = scratch_path(spark, "upsert")
    stream = _event_stream(spark, d).select("user_id", "event_id", "event_type", "value")
    stream_upsert(stream, target, "user_id", scratch_path(spark, "state"), ["event_id"]).awaitTermination()
    return read_latest(spark, target, "user_id")


@query("stream_upsert_two_streams", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def _stream_upsert_two_streams(spark, d):
    # two streams with checkpoints of their own and several batches each, one target, then compacted
    target = scratch_path(spark, "upsert")
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    for part in (0, 1):
        source = scratch_path(spark, "half")
        events.filter(F.col("event_id") % 2 == part).repartitionByRange(3, "event_id").write.parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_upsert(stream, target, "user_id", scratch_path(spark, "state"), ["event_id"]).awaitTermination()
    return compact(spark, target, scratch_path(spark, "compact"), "user_id", ["event_id"])


@query("checkpoint_merge", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
  FROM events GROUP BY ALL""")
def _checkpoint_merge(spark, d):
    # several files and one per trigger, so that work is saved in several steps
    source, target = scratch_path(spark, "work"), scratch_path(spark, "saved")
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    events.repartitionByRange(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    checkpoint_merge(stream, target, ["user_id", "event_type"], scratch_path(spark, "state"), ["event_id"]).awaitTermination()
    return read_latest(spark, target, ["user_id", "event_type"], ["event_id"])


@query("stream_progress", """WITH l AS (SELECT user_id, floor(value / 10)::BIGINT AS idx, arg_max(event_type, event_id) AS state
    FROM events GROUP BY ALL)
  SELECT user_id, count(*) AS segments_total, count(*) FILTER (state = 'purchase') AS done,
    round_even(count(*) FILTER (state = 'purchase') / count(*), 4) AS progress FROM l GROUP BY user_id""")
def _stream_progress(spark, d):
    target = scratch_path(spark, "live")
    stream = _event_stream(spark, d).select(
        "user_id", F.floor(F.col("value") / 10).alias("idx"),
        F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("state"),
        F.col("event_id").alias("ts"))
    stream_progress(stream, target, ["user_id"], scratch_path(spark, "state")).awaitTermination()
    rows = read_progress(spark, target, ["user_id"])
    return rows.select("user_id", "segments_total", F.coalesce(F.try_element_at("segments", F.lit("done")), F.lit(0))
                       .alias("done"), "progress")
