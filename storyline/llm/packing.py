"""Packing of texts into training sequences of a fixed length, by best fit under conflicts.

A text longer than a sequence gives whole sequences and one remainder.  Pieces go
into bins from the longest down.  Bins stand in order of the room they have left;
a piece takes the bin with the least sufficient room (its successor in that
order) that is compatible, going on to the next larger room until one is.  A bin
keeps two bitmaps, of the sources and of the duplicate clusters it holds, and is
compatible with a piece that has neither.  A piece without one opens a new bin.

Pieces are dealt at random over shards of bounded size, each packed on its own,
so a hot source or cluster is spread over all shards and nothing is collected.

Null sources and clusters conflict with nothing.  Pieces without length take no
place and are not packed.  Ties are decided by key and piece, so the result does
not depend on partitions.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .jaccard import _classes

SHARD = 4096  # pieces of a shard, on average


def pack(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """The bin and the place in it of each (length, source, cluster), in the given order."""
    bits: dict = {}
    bins: list[list[int]] = []  # room, sources, clusters, used
    rooms: list[int] = []  # different rooms that some bin has
    by_room: dict[int, list[int]] = defaultdict(list)
    placed = []
    for length, source, cluster in pieces:
        own_source = 0 if source is None else 1 << bits.setdefault(("s", source), len(bits))
        own_cluster = 0 if cluster is None else 1 << bits.setdefault(("c", cluster), len(bits))
        chosen = None
        for at in range(bisect_left(rooms, length), len(rooms)):
            for b in by_room[rooms[at]]:
                if not (bins[b][1] & own_source or bins[b][2] & own_cluster):
                    chosen = b
                    break
            if chosen is not None:
                break
        if chosen is None:
            chosen = len(bins)
            bins.append([capacity, 0, 0])
        else:
            room = bins[chosen][0]
            by_room[room].remove(chosen)
            if not by_room[room]:
                del by_room[room]
                rooms.pop(bisect_left(rooms, room))
        held = bins[chosen]
        placed.append((chosen, capacity - held[0]))
        held[0] -= length
        held[1] |= own_source
        held[2] |= own_cluster
        if held[0]:
            if held[0] not in by_room:
                insort(rooms, held[0])
            insort(by_room[held[0]], chosen)
    return placed


def best_fit(lengths: DataFrame, capacity: int, key: str = "doc_id", length: str = "n_tokens",
             source: str = "source", cluster: str = "cluster") -> DataFrame:
    """One row per piece: ``sequence_id``, ``position`` in it, ``key``, ``piece``, ``start`` in the text, ``length``."""
    rows = lengths.select(F.col(key).alias("__key"), F.col(length).cast("long").alias("n"),
                          F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    pieces = (rows.filter("n > 0")
              .withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity}L)")))
              .select("__key", "piece", "source", "cluster", (F.col("piece") * capacity).alias("start"),
                      F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length")))
    # rows may repeat and keys be null, so equal pieces are numbered
    whole = (pieces.filter(F.col("length") == capacity).groupBy("__key", "piece", "start", "length")
             .agg(F.count("*").alias("times")).withColumn("ordinal", F.explode(F.expr("sequence(1L, times)")))
             .select(F.concat_ws("-", F.when(F.col("__key").isNull(), "n").otherwise("w"), "__key", "piece",
                                 "ordinal").alias("sequence_id"),
                     F.lit(0).cast("long").alias("position"), "__key", "piece", "start", "length"))
    # one remainder a row at most, so the number of rows gives the number of shards
    shards = max(1, -(-rows.count() // SHARD))
    rest = pieces.filter(F.col("length") < capacity).withColumn(
        "shard", F.pmod(F.xxhash64("__key", "piece", "length"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("__key", "ascending"), ("piece", "ascending"),
                               ("source", "ascending"), ("cluster", "ascending")])
        columns = [table.column(c).to_pylist() for c in ("length", "source", "cluster")]
        placed = pack(list(zip(*columns)), capacity)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        return pa.table({
            "sequence_id": pa.array([f"{shard}-{b}" for b, _ in placed], pa.string()),
            "position": pa.array([p for _, p in placed], pa.int64()),
            "__key": table.column("__key"), "piece": table.column("piece"), "start": table.column("start"),
            "length": table.column("length")})

    kind = dict(lengths.dtypes)[key]
    packed_rest = rest.groupBy("shard").applyInArrow(
        packed, f"sequence_id string, position long, __key {kind}, piece long, start long, length long")
    return whole.union(packed_rest).withColumnRenamed("__key", key)


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """Documents (doc_id, text, source) packed by words; one source and one of linked near copies per sequence.

    A text has its words and one end mark.  Texts without words are one cluster.
    """
    # rows that agree in key and text are one name; texts are split into words once, for their shingles
    named = _classes(docs, "doc_id", "text", 5, 80).select(
        "__rid", (F.col("n_words") + 1).alias("n_tokens"),
        F.coalesce(F.col("root").cast("string"), F.lit("blank")).alias("cluster")).distinct()
    rows = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("__rid"), "doc_id", "source")
    return best_fit(cut_lineage(rows.join(named, "__rid").drop("__rid")), capacity)
