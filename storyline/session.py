"""Session settings, the shared folder and cutting a lineage there."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Only settings that change how plans are made; memory, cores and partition
# counts belong to whoever submits the job.
_PLANNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("storyline")
    settings = {
        **_PLANNING,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it there is no folder
    that all executors share, and this is an error.  Only a session of one machine
    (``local[...]``: tests, a laptop) takes a temporary folder instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = spark.conf.get("storyline.scratch", None)
    if not made:
        made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("storyline.scratch", made)
    return made


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, not yet created."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")
    _made.append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder so far; returns how many folders.

    For the end of a job: results that were not written elsewhere cannot be read afterwards.
    """
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    Used where an intermediate result is read more than once and is costly to
    work out again.  It outlives the loss of any executor, and unlike an RDD
    checkpoint its readers take only the columns they need and know its size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Give a scan with fewer partitions than cores enough of them.

    Text work is narrow and heavy, so it runs only as wide as its input is split.
    A large table has far more splits than there are cores and is returned as it
    is; a file of one row group is shuffled once by ``cols``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *cols)
