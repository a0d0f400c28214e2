"""Expensive per-row calls, made once per distinct content."""
from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .cache import Cache, KeyMap

# Fixed values (must equal the reference's).
ATTEMPTS = 6
FIRST_DELAY_S = 1.0
MAX_DELAY_S = 60.0
JITTER = (0.7, 1.3)


class PermanentError(RuntimeError):
    """Raised by the user's function for input that will never succeed."""


def with_retries(fn: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = ATTEMPTS,
                 first_delay_s: float = FIRST_DELAY_S) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Call ``fn`` again after transient errors, waiting longer each time."""
    def call(batch: pd.DataFrame) -> pd.DataFrame:
        for n in range(attempts):
            try:
                return fn(batch)
            except PermanentError:
                raise
            except Exception as error:  # noqa: BLE001 - anything else may be transient
                if n == attempts - 1:
                    raise RuntimeError(f"failed after {attempts} attempts: {error}") from error
                time.sleep(min(MAX_DELAY_S, first_delay_s * 2 ** n) * random.uniform(*JITTER))
    return call


def cached_enrich(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
                  schema: str | T.StructType, cache_path: str, ord: Sequence[str], concurrency: int | None = None,
                  inputs: Sequence[str] = (), attempts: int = ATTEMPTS,
                  first_delay_s: float = FIRST_DELAY_S, batch_rows: int = 64,
                  stage: bool = True) -> DataFrame:
    """Add ``fn``'s columns and ``was_cached`` to every row.

    ``fn`` gets pandas batches with ``key`` and ``inputs`` and returns one row
    per key with the columns of ``schema``.  It sees every key that is not in
    the cache exactly once per successful task; results are appended to the
    cache (see :mod:`.cache`; only files that may hold a key of the batch are read)
    and joined back to all rows.  ``concurrency`` bounds the number of simultaneous calls.  ``was_cached`` is
    false for the first row (by ``ord``, unique within a key) of a key that had
    to be computed.

    If a batch fails for good, its keys are called one by one.  All successes are
    committed before the first errors are raised, so the next run calls only what
    failed.

    ``df`` is read twice, for its keys and for the result; ``stage`` writes it
    once before that.  Leave it off when ``df`` is a stored table.
    """
    if not ord:
        raise ValueError("ord must name the columns that order the rows of a key")
    spark = df.sparkSession
    if stage:
        df = cut_lineage(df)
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # "first_row" names the row that caused the call
    first = F.to_json(F.struct(*ord))
    stored = T.StructType([T.StructField("key", df.schema[key].dataType), *added.fields,
                           T.StructField("first_row", T.StringType())])
    run = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
    distinct = df.groupBy(F.col(key).alias("key")).agg(
        F.min_by(F.struct(*inputs, first.alias("first_row")), F.struct(*ord)).alias("i")).select("key", "i.*")
    cache, wanted = Cache(spark, cache_path, stored), KeyMap(df, key)
    parts = cache.parts_for(wanted)
    missing = distinct.join(cache.rows(parts).select("key"), "key", "left_anti") if parts else distinct
    if concurrency:
        missing = missing.repartition(concurrency, "key")
    call = with_retries(fn, attempts, first_delay_s)
    names = [f.name for f in added.fields]

    def enriched(part: pd.DataFrame) -> pd.DataFrame:
        got = call(part[["key", *inputs]].rename(columns={"key": key}))
        got = got.rename(columns={key: "key"})[["key", *names]]
        return part[["key", "first_row"]].merge(got, on="key", how="left", validate="one_to_one").assign(error=None)

    def enrich(batches):
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at:at + batch_rows]
                rows = []
                try:
                    rows.append(enriched(part))
                except Exception as whole:  # noqa: BLE001 - said again for the keys it belongs to
                    for i in range(len(part)):
                        one = part.iloc[i:i + 1]
                        try:
                            if len(part) == 1:
                                raise whole
                            rows.append(enriched(one))
                        except Exception as error:  # noqa: BLE001
                            rows.append(one[["key", "first_row"]].assign(
                                **{n: None for n in names}, error=f"{type(error).__name__}: {error}"[:500]))
                for out in rows:
                    yield out[["key", *names, "first_row", "error"]]

    computed = T.StructType([*stored.fields, T.StructField("error", T.StringType())])
    failed = cache.write(missing.mapInPandas(enrich, computed), run, wanted.range_bits)
    if failed:
        raise RuntimeError("some keys failed, all others are cached: " + "; ".join(f"{k}: {e}" for k, e in failed))
    known = cache.rows([*parts, (run, None)]).withColumnRenamed("key", key)
    fresh = (F.col("run") == run) & (F.col("first_row") == first)
    return df.join(known, key, "left").withColumn("was_cached", ~fresh).select(
        *df.columns, *names, "was_cached")


def progress_stats(enriched: DataFrame, elapsed_s: float | None = None, total: int | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """``(done, cached, net, rate, eta_s)`` of an enrichment."""
    counts = enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("done"), F.count_if("was_cached").alias("cached"),
        F.count_if(~F.col("was_cached")).alias("net"))
    el = F.lit(float(elapsed_s or 0.0))
    rate = F.when(el > 0, F.col("done") / el).otherwise(F.lit(0.0))
    left = (F.lit(total) if total is not None else F.col("done")) - F.col("done")
    return counts.withColumn("rate", rate).withColumn(
        "eta_s", F.when(F.col("rate") > 0, left / F.col("rate")).otherwise(F.lit(0.0)))
