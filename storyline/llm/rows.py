"""Keys of rows, filters by key and components of links."""
from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

_FILTER_BITS = 24


class IdFilter:
    """A set of 64-bit keys as 2**24 bits (2 MB, however many keys).

    ``may_hold`` is never wrong about a key that is in the set.  Others pass with
    a probability that grows with the set, so an exact join has to follow; the
    filter only saves moving the texts of rows that have no partner.
    """

    def __init__(self, keys: DataFrame, column: str):
        slot = F.xxhash64(F.col(column)).bitwiseAND((1 << _FILTER_BITS) - 1)
        words = (keys.select(slot.alias("s"))
                 .groupBy(F.shiftright("s", 6).alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")))
        self.bits = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
        got = words.toArrow()  # 2**18 rows at most
        if got.num_rows:
            self.bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    @staticmethod
    def slot(column: str):
        """The column that ``may_hold`` takes, made by Spark."""
        return F.xxhash64(F.col(column)).bitwiseAND((1 << _FILTER_BITS) - 1).cast("int")

    def may_hold(self, slots) -> np.ndarray:
        s = np.asarray(slots).astype(np.uint64)
        return (self.bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) > 0


class Steps:
    """Tables that an operator writes to the shared folder, and drops when they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "step")
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = stored, path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables on which nothing that is still to be read depends."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()  # Spark removes the shuffle files of plans that nothing refers to


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b): the smallest node reachable.

    Rounds of large stars and small stars: each hangs the neighbours of a node on
    the smallest among them, with one aggregation and one join.  No task gathers
    a node's neighbours, and the number of rounds grows with the logarithm of the
    longest chain.  Every round is written to the shared folder.
    """
    spark = links.sparkSession
    steps = Steps(spark)
    edges = steps.write(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, edges = edges, steps.write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        steps.drop(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots) if state[0] else spark.createDataFrame([], "node long, root long")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
