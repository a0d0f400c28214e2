"""A quality classifier: perplexity under a model of trusted text, judged per language.

The model is an interpolated modified Kneser-Ney model of bytes (four by default).
It is counted from trusted documents with Spark: n-gram counts are aggregated,
each lower order counts the different n-grams above it, and the counts of n-grams
and of their contexts are joined, order by order, into one probability for every
n-gram that occurs and one back-off weight for every context.

For scoring the two tables are dealt into shards of bounded size.  A task joins
the n-grams of its documents with one shard after the other, so it holds one shard
and one batch of texts, however large the model is; the corpus is not shuffled.

A document is kept if its perplexity lies between two quantiles of other trusted
documents of its language, held out from training: text that is too hard to
predict is junk, text that is too easy repeats itself.  Languages with too few
trusted documents (and null) use the quantiles of all.

Null is the empty text; a text shorter than one n-gram is judged by nothing and kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage, scratch_path
from .language_model import discounts
from .repeats import passing
from .rows import IdFilter
from .store import local_path
from .words import bytes_of, ranges, slices

QUANTILES = (0.005, 0.995)
_LEAST_DOCS = 100  # of a language, for quantiles of its own
_SHARD_ROWS = 1 << 20


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of every text as a number, and how many each text has."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    at = ranges(offsets[:-1], count)
    keys = np.zeros(len(at), np.int64)
    for i in range(n):
        keys = keys << 8 | data[at + i]
    return keys, count


def _counts(n: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            keys, times = np.unique(_grams(*bytes_of(batch.column("__text")), n)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["gram", "n"])
    return emit


@dataclass(frozen=True)
class QualityModel:
    """Shards of (gram, log10 probability) and (context, log10 weight), by order; and the quantiles."""

    order: int
    tables: str  # Parquet in the shared folder, partitioned by kind, order and shard
    shards: dict[tuple[str, int], int]
    unseen: float
    limits: dict[str | None, tuple[float, float]]


def _counts_by_order(trusted: DataFrame, order: int) -> dict[int, DataFrame]:
    """Counts of the highest order; below, how many different n-grams end in each."""
    counts = {order: cut_lineage(trusted.mapInArrow(_counts(order), "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")))}
    for k in range(order - 1, 0, -1):
        counts[k] = cut_lineage(counts[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(
            F.count("*").alias("n")))
    return counts


def _probabilities(counts: dict[int, DataFrame], order: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """Per order (gram, p) and (context, gamma), and the probability of a byte never seen."""
    p: dict[int, DataFrame] = {}
    gamma: dict[int, DataFrame] = {}
    unseen = 1.0 / 257
    for k in range(1, order + 1):
        seen = counts[k].agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first()
        d = discounts(*[s or 0 for s in seen])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("gram", "n", F.shiftright("gram", 8).alias("context"), off.alias("d"))
        weights = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("kept")).select(
            "context", "total", (F.col("kept") / F.col("total")).alias("gamma"))
        with_context = rows.join(weights, "context")
        own = (F.col("n") - F.col("d")) / F.col("total")
        if k == 1:
            first = weights.first()
            spare = float(first.gamma) if first else 1.0
            p[k] = with_context.select("gram", (own + F.lit(spare / 257)).alias("p"))
            unseen = spare / 257
        else:
            below = p[k - 1].select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            p[k] = with_context.withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(
                below, "tail").select("gram", (own + F.col("gamma") * F.col("low")).alias("p"))
        p[k] = cut_lineage(p[k])
        gamma[k] = weights.select("context", "gamma")
    return p, gamma, unseen


def _stored(p: dict[int, DataFrame], gamma: dict[int, DataFrame], order: int) -> tuple[str, dict]:
    """Write both tables in shards by key, each of at most about a million rows."""
    spark = p[order].sparkSession
    folder, shards = scratch_path(spark, "quality-model"), {}
    for kind, tables, key, value in (("p", p, "gram", "p"), ("gamma", gamma, "context", "gamma")):
        for k in range(1, order + 1):
            n = max(1, -(-tables[k].count() // _SHARD_ROWS))
            shards[kind, k] = n
            rows = tables[k].select(F.col(key).alias("key"), F.log10(value).alias("log"),
                                    F.pmod(F.xxhash64(key), F.lit(n)).alias("shard"))
            rows.repartition(n, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(
                f"{folder}/{kind}-{k}")
    return folder, shards


class _Shards:
    """Reads a model's shards; keeps a model of one shard per table, reads larger ones again for every batch."""

    def __init__(self, model: QualityModel):
        self.model = model
        self.kept: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, kind: str, k: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if (kind, k, shard) not in self.kept:
            path = f"{self.model.tables}/{kind}-{k}/shard={shard}"
            local = local_path(path)
            system, name = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)
            try:
                table = dataset.dataset(name, filesystem=system, format="parquet").to_table(columns=["key", "log"])
                key, log = table.column("key").to_numpy(), table.column("log").to_numpy()
            except FileNotFoundError:
                key, log = np.zeros(0, np.int64), np.zeros(0)
            order = np.argsort(key)
            pair = key[order], log[order]
            if self.model.shards[kind, k] > 1:
                return pair
            self.kept[kind, k, shard] = pair
        return self.kept[kind, k, shard]

    def join(self, kind: str, k: int, keys: np.ndarray) -> np.ndarray:
        """The logarithm of every key; NaN where the table has none."""
        out = np.full(len(keys), np.nan)
        for shard in range(self.model.shards[kind, k]):
            own, log = self.read(kind, k, shard)
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                out = np.where(own[at] == keys, log[at], out)
        return out

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """By the longest part that was seen, with the weights of the contexts passed on the way."""
        order = self.model.order
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(order, 0, -1):
            part = grams[left] & ((1 << 8 * k) - 1)
            log = self.join("p", k, part)
            found = ~np.isnan(log)
            out[left[found]] += log[found]
            left, part = left[~found], part[~found]
            if not len(left):
                return out
            if k > 1:
                weight = self.join("gamma", k, part >> 8)
                out[left] += np.where(np.isnan(weight), 0.0, weight)
        out[left] += np.log10(self.model.unseen)
        return out


def with_perplexity(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "perplexity") -> DataFrame:
    """All rows and columns, and the perplexity per byte (null for texts shorter than an n-gram)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(model)
        for batch in slices(batches, text, 1 << 20):
            grams, count = _grams(*bytes_of(batch.column(text)), model.order)
            unique, which = np.unique(grams, return_inverse=True)
            log = shards.log_probability(unique)[which]
            total = np.concatenate([[0.0], np.cumsum(log)])
            edge = np.concatenate([[0], np.cumsum(count)])
            mean = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.round(10 ** -mean, 9), mask=count == 0)], names=[*batch.schema.names, out])

    return docs.mapInArrow(emit, schema)


def learn_quality(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  order: int = 4, quantiles: tuple[float, float] = QUANTILES) -> QualityModel:
    """Fit on all rows of ``docs`` that ``trusted`` names (column ``key``): half to count, half for the quantiles."""
    chosen = (trusted.select(F.col(key).cast(docs.schema[key].dataType).alias("__key"))
              .filter("__key is not null").distinct())
    named = docs.select(F.col(key).alias("__key"), F.coalesce(text, F.lit("")).alias("__text"),
                        F.col(lang).cast("string").alias("__lang"), IdFilter.slot(key).alias("__slot"))
    # the filter leaves few texts to move; the keys, of any number, are not sent to every task
    rows = cut_lineage(passing(named, IdFilter(chosen, "__key"), True).drop("__slot").join(chosen.hint("merge"), "__key"))
    # copies of a text are in the same half
    half = F.pmod(F.xxhash64("__text"), F.lit(2))
    counts = _counts_by_order(rows.filter(half == 0).select("__text"), order)
    p, gamma, unseen = _probabilities(counts, order)
    folder, shards = _stored(p, gamma, order)
    model = QualityModel(order, folder, shards, unseen, {})
    scored = cut_lineage(with_perplexity(rows.filter(half == 1), model, "__text", "__ppl")
                         .filter("__ppl is not null").select("__lang", "__ppl"))
    both = F.percentile_approx("__ppl", list(quantiles), 10_000).alias("q")
    limits = {None: tuple(r.q) for r in scored.agg(both).collect() if r.q}
    # languages are few; the most frequent thousand have limits of their own
    for r in (scored.groupBy("__lang").agg(F.count("*").alias("n"), both)
              .filter((F.col("n") >= _LEAST_DOCS) & F.col("__lang").isNotNull())
              .orderBy(F.desc("n"), "__lang").limit(1000).collect()):
        limits[r["__lang"]] = tuple(r.q)
    return QualityModel(order, folder, shards, unseen, limits)


def classified(docs: DataFrame, model: QualityModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns, ``__perplexity`` and whether to keep the row (``__keep``)."""
    scored = with_perplexity(docs, model, text, "__perplexity")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    if None in model.limits:
        low, high = (F.lit(float(v)) for v in model.limits[None])
    named = [(k, v) for k, v in model.limits.items() if k is not None]
    if named:
        table = F.create_map(*[F.lit(x) for k, v in named for x in (k, [float(b) for b in v])])
        own = F.element_at(table, F.coalesce(F.col(lang).cast("string"), F.lit("")))
        low, high = F.coalesce(F.get(own, F.lit(0)), low), F.coalesce(F.get(own, F.lit(1)), high)
    keep = F.coalesce((F.col("__perplexity") >= low) & (F.col("__perplexity") <= high), F.lit(True))
    return scored.withColumn("__keep", keep)
