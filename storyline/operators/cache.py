"""A cache of computed rows: runs of files by key range, each listed in a manifest.

``data/run=<id>/range=<r>`` holds what one run computed, dealt by the leading bits of
the key's hash; a small run has one range and one file.  ``manifest/<id>.json`` lists
the ranges with a map of 65,536 bits over the hashes in each.  A run is part of the
cache from the moment its manifest is there, so what an interrupted run wrote is
never read.
"""
from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RANGE_ROWS = 500_000     # rows per range, about
_SLOT_BITS = 24
_MAP_BITS = 16
_MOST_RANGE_BITS = _SLOT_BITS - _MAP_BITS


def _lead(key: Column, bits: int) -> Column:
    """The leading bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string")), 64 - bits).cast("int") if bits else F.lit(0)


def _bits(rows: DataFrame, slot: Column, size: int, *by: str) -> dict[tuple, np.ndarray]:
    """Which slots occur, per value of ``by``."""
    words = rows.select(*by, slot.alias("s")).groupBy(*by, F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("b")).toArrow()    # size / 64 rows at most
    out: dict[tuple, np.ndarray] = {}
    groups = list(zip(*[words.column(c).to_pylist() for c in by])) if by else [()] * len(words)
    for group, w, b in zip(groups, words.column("w").to_pylist(), words.column("b").to_pylist()):
        if group not in out:
            out[group] = np.zeros(size // 64, np.int64)
        out[group][w] = b
    return {g: np.unpackbits(m.view(np.uint8), bitorder="little").astype(bool) for g, m in out.items()}


class KeyMap:
    """The keys of a batch as 2**24 bits of their hashes."""

    def __init__(self, rows: DataFrame, key: str):
        found = _bits(rows.filter(F.col(key).isNotNull()), _lead(F.col(key), _SLOT_BITS), 1 << _SLOT_BITS)
        self.slots = found.get((), np.zeros(1 << _SLOT_BITS, bool))

    @property
    def range_bits(self) -> int:
        """How many leading bits deal as many keys into ranges of ``RANGE_ROWS``."""
        return min(_MOST_RANGE_BITS, max(0, int(np.ceil(np.log2(max(1, int(self.slots.sum()) / RANGE_ROWS))))))

    def ranges(self, entry: dict) -> list[int]:
        """The ranges of a run that may hold one of the keys."""
        mine = self.slots.reshape(1 << entry["bits"], 1 << _MAP_BITS, -1).any(axis=2)
        return [int(r) for r, packed in entry["ranges"].items()
                if (mine[int(r)] & np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(packed)), np.uint8)).astype(bool)).any()]


class Cache:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        """``schema``: the columns of a cached row, ``key`` among them; ``error`` and ``run`` are added."""
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([*schema.fields, T.StructField("error", T.StringType()), T.StructField("run", T.StringType()),
                                    T.StructField("range", T.IntegerType())])
        self.columns = [*schema.names, "run"]

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        path, system = self._files(f"{self.path}/manifest")
        if not system.exists(path):
            return []
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest", pathGlobFilter="*.json").collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda e: e["run"])

    def rows(self, parts: Sequence[tuple[str, int | None]]) -> DataFrame:
        """One row per key of (run, range) parts, the least run's; a key two runs made at once is taken once."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        paths = [f"{self.path}/data/run={run}" + ("" if r is None else f"/range={r}") for run, r in parts]
        rows = (self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths)
                .filter("error is null").select(*self.columns))
        if len({run for run, _ in parts}) == 1:
            return rows
        return rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in self.columns if c != "key"]), F.col("run")).alias("c")).select(
            "key", "c.*").select(*self.columns)

    def parts_for(self, keys: KeyMap) -> list[tuple[str, int]]:
        return [(e["run"], r) for e in self.entries() for r in keys.ranges(e)]

    def write(self, rows: DataFrame, run: str, bits: int) -> list[tuple[str, str]]:
        """Store rows of a run and list it; returns the first few (key, error) of rows that failed."""
        folder = f"{self.path}/data/run={run}"
        (rows.withColumn("range", _lead(F.col("key"), bits)).repartition(1 << bits, "range")
         .write.partitionBy("range").parquet(folder))
        stored = self.spark.read.schema(T.StructType([f for f in self.schema if f.name != "run"])).parquet(folder)
        slot = F.shiftrightunsigned(F.shiftleft(F.xxhash64(F.col("key").cast("string")), bits), 64 - _MAP_BITS).cast("int")
        failed = F.col("error").isNotNull()
        maps = _bits(stored.withColumn("bad", failed), slot, 1 << _MAP_BITS, "range", "bad")
        good = {r: m for (r, bad), m in maps.items() if not bad}
        if good:
            self._commit({"run": run, "bits": bits, "ranges": {
                str(r): base64.b64encode(zlib.compress(np.packbits(m).tobytes())).decode() for r, m in good.items()}})
        if len(good) == len(maps):
            return []
        return [tuple(r) for r in stored.filter(failed).select(F.col("key").cast("string"), "error").limit(5).collect()]

    def _commit(self, entry: dict) -> None:
        part, system = self._files(f"{self.path}/manifest/_{entry['run']}.part")
        out = system.create(part, True)
        out.write(json.dumps(entry).encode())
        out.close()
        system.rename(part, self._files(f"{self.path}/manifest/{entry['run']}.json")[0])

    def drop(self, run: str) -> None:
        for name, deep in ((f"manifest/{run}.json", False), (f"data/run={run}", True)):
            path, system = self._files(f"{self.path}/{name}")
            system.delete(path, deep)


def compact_cache(spark: SparkSession, path: str, run: str) -> int:
    """Rewrite all runs of a cache as one named ``run``; returns how many there were.

    Runs committed meanwhile stay as they are.  Nothing else may read the old runs.
    """
    fields = spark.read.parquet(f"{path.rstrip('/')}/data").schema
    cache = Cache(spark, path, T.StructType([f for f in fields if f.name not in ("error", "run", "range")]))
    old = cache.entries()
    rows = cache.rows([(e["run"], None) for e in old])
    if old:
        cache.write(rows.drop("run").withColumn("error", F.lit(None).cast("string")), run, KeyMap(rows, "key").range_bits)
        for entry in old:
            cache.drop(entry["run"])
    return len(old)
