"""Structured Streaming twins of the incremental operators."""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import progress
from ..sources.readers import parse_log_line
from ..sources.tail import TAIL_BYTES, LogTail
from .first_seen import ROCKSDB, FirstSeen, interval_ms



def stream_tail(spark: SparkSession, path: str, positions: str, max_bytes: int = TAIL_BYTES) -> DataFrame:
    """Lines added to log files, parsed; at most ``max_bytes`` of each file per trigger.

    ``path`` is a file, a folder or a pattern of file names; files may be added and
    may grow, and each line arrives once.  A file found shorter than it was read is
    read from its start.  A line arrives when its end is written; one longer than
    ``max_bytes`` arrives whole.  A restart goes on where the checkpoint ends;
    ``positions`` is a folder of this stream's own that lives as long as the checkpoint.

    A trigger takes one portion: ``availableNow`` ends after it, and
    ``StreamingQuery.processAllAvailable`` goes on until nothing is left.
    """
    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").options(path=path, positions=positions, max_bytes=max_bytes).load()
    return lines.select("path", "at", *parse_log_line(F.col("value")))


def stream_first_seen(stream: DataFrame, key: str, ts: str | None = None, watermark: str | None = None,
                      unbounded: bool = False, order: Sequence[str] | None = None,
                      keep: str | None = None) -> DataFrame:
    """The first row per key, over all batches.

    With ``ts`` and ``watermark`` the row with the least ``ts`` (then the least
    ``order``) wins, in whatever order rows arrive within the watermark's delay.  It
    is put out when the watermark reaches its ``ts``, as no earlier row can follow
    then.  Its key is remembered for ``keep`` longer (an interval; the watermark's
    delay by default), and rows of the key that come in that time are dropped.  So
    the state holds one row for each key of that span; a key that comes back later is
    new.  The state store has to be RocksDB; it is set for the session.

    Without a watermark nothing tells when a key's first row is final: the first row
    to arrive is taken, and its key kept for ever, which has to be asked for with
    ``unbounded``.
    """
    if not (watermark and ts):
        if not unbounded:
            raise ValueError("give ts and watermark, or unbounded=True to keep every key for ever")
        return stream.dropDuplicates([key])
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rest = [f for f in stream.schema if f.name != key]
    names = [ts, *(order or [])]
    processor = FirstSeen(key, T.StructType(rest), names, interval_ms(keep or watermark))
    return (stream.withWatermark(ts, watermark).groupBy(key)
            .transformWithState(processor, T.StructType([stream.schema[key], *rest]), "Append", "EventTime")
            .select(*stream.columns))


def _latest(rows: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


_STORED = ("stream", "batch", "written_ms")


def read_latest(spark: SparkSession, target: str, key, order: Sequence[str] = ()) -> DataFrame:
    """Latest record per key of an upsert target.

    The batch written last wins; with ``order`` the largest value of these columns
    does, so a record that arrives late does not replace a newer one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = spark.read.parquet(target)
    return _latest(rows, keys, [*order, "written_ms", "batch"]).select(*[c for c in rows.columns if c not in _STORED])


def stream_upsert(stream: DataFrame, target: str, key, checkpoint: str,
                  order: Sequence[str] = ()) -> StreamingQuery:
    """Merge a stream into ``target`` by key; one writer per target at a time.

    A batch is written as one folder named by the stream's identity, which its
    checkpoint keeps, and the batch's number.  It holds one record per key: the
    last by ``order``, or without one the greatest.  Writing costs as much as the
    batch, however large the target; a batch that is run again after a failure
    replaces its own folder only, and a new checkpoint adds to what is there.
    :func:`read_latest` gives the merged records, :func:`compact` rewrites them.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def merge(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        by = list(order) or [c for c in batch.columns if c not in keys] or keys
        rows = _latest(batch, keys, by).withColumn("written_ms", F.unix_millis(F.current_timestamp()))
        rows.write.mode("overwrite").parquet(os.path.join(target, f"stream={stream_id}", f"batch={number}"))

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def compact(spark: SparkSession, target: str, compacted: str, key, order: Sequence[str] = ()) -> DataFrame:
    """Write the latest records of ``target`` to the new folder ``compacted`` and return them.

    The result is a target itself: later streams may be merged into it.
    """
    rows = read_latest(spark, target, key, order).withColumn("written_ms", F.lit(0).cast("bigint"))
    rows.write.parquet(os.path.join(compacted, "stream=compacted", "batch=0"))
    return read_latest(spark, compacted, key, order)


def checkpoint_merge(stream: DataFrame, target: str, key, checkpoint: str,
                     order: Sequence[str] = ()) -> StreamingQuery:
    """Save finished work in bounded batches, so a kill loses at most one.

    The bound belongs to the source (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``); a restart goes on behind the last saved batch.
    """
    return stream_upsert(stream, target, key, checkpoint, order)


def stream_progress(stream: DataFrame, target: str, keys: Sequence[str], checkpoint: str,
                    idx: str = "idx", ts: str = "ts") -> StreamingQuery:
    """Keep the latest state per segment from a stream of status rows.

    ``stream(keys, idx, state, ts)``; :func:`read_progress` turns it into
    progress per job.
    """
    rows = stream.select(*keys, idx, "state", ts)
    return stream_upsert(rows, target, [*keys, idx], checkpoint, [ts])


def read_progress(spark: SparkSession, target: str, keys: Sequence[str], idx: str = "idx",
                  phases: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Progress per job from what :func:`stream_progress` has stored so far.

    A row that arrives late with an older time does not win over a newer one.
    """
    segments = read_latest(spark, target, [*keys, idx], [ts])
    if phases is None:
        phases = segments.select(*keys, F.lit("").alias("phase"), F.lit(False).alias("done")).limit(0)
    return progress(phases, segments, keys)
