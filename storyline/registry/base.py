"""Where checked queries and their SQL are kept."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# One unit of speech takes 60 ms per character: a whole number of bytes.
BYTES_PER_CHAR = 2880


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table of texts, wide enough for text work."""
    return spread(table(spark, sf_dir, name), *keys)


def nbytes(text: str = "text"):
    return (F.length(text) * BYTES_PER_CHAR).cast("bigint")
