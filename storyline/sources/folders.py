"""One small text file for each name, in folders ``key=value/...`` as Spark's own writer makes them.

Spark's writer opens every folder through the committer, and its driver moves all
files into place one after another.  Here a task writes a file beside its place and
moves it there itself, and keeps an index of what it wrote.  An attempt that is run
again replaces the same files.  ``_SUCCESS`` tells that all tasks are done.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .packs import file_system

_READ_ROWS = 4096
# What Spark escapes in the name of a folder.
_ESCAPED = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\x7f{[]^"]}
_NULL = "__HIVE_DEFAULT_PARTITION__"
_FILE, _INDEX = "part-00000.txt", "_index"


@dataclass
class Written(WriterCommitMessage):
    index: str | None


class TextFolders(DataSource):
    """Format ``text_folders``: rows (names ..., the same as strings ..., value) ordered by name; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "text_folders"

    def writer(self, schema, overwrite: bool) -> "FolderWriter":
        names = schema.fields[:len(schema.fields) // 2]
        return FolderWriter(self.options["path"], pa.schema([(f.name, to_arrow_type(f.dataType)) for f in names]))


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: pa.Schema):
        self.path, self.names, self.run = path, names, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        task = TaskContext.get()
        stem = f"{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}"
        names: list[tuple] = []
        places: list[str] = []
        out, width = None, len(self.names)

        def close() -> None:
            if out is not None:
                out.close()
                replace(system, f"{path}/{places[-1]}/.{stem}", f"{path}/{places[-1]}/{_FILE}")

        for batch in iterator:
            own = list(zip(*[batch.column(i).to_pylist() for i in range(width)]))
            texts = list(zip(*[batch.column(i).to_pylist() for i in range(width, 2 * width)]))
            for name, text, line in zip(own, texts, batch.column(2 * width).to_pylist()):
                if not names or name != names[-1]:
                    close()
                    places.append("/".join(f"{f.name}={t.translate(_ESCAPED) if t else _NULL}" for f, t in zip(self.names, text)))
                    names.append(name)
                    system.create_dir(f"{path}/{places[-1]}")
                    out = system.open_output_stream(f"{path}/{places[-1]}/.{stem}")
                out.write((line + "\n").encode())
        close()
        return Written(self._index(stem, names, places) if names else None)

    def _index(self, stem: str, names: list[tuple], places: list[str]) -> str:
        system, path = file_system(self.path)
        system.create_dir(f"{path}/{_INDEX}")
        columns = [pa.array([n[i] for n in names], f.type) for i, f in enumerate(self.names)]
        with system.open_output_stream(f"{path}/{_INDEX}/{stem}.parquet") as file:
            pq.write_table(pa.table([*columns, pa.array(places, pa.string())], names=[*self.names.names, "__place"]), file)
        return f"{stem}.parquet"

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        system.create_dir(path)
        keep = {m.index for m in messages if m is not None and m.index} or {self._index(self.run, [], [])}
        for info in system.get_file_info(fs.FileSelector(f"{path}/{_INDEX}", allow_not_found=True)):
            if info.base_name not in keep:     # of attempts that do not count
                system.delete_file(info.path)
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        """Without ``_SUCCESS`` nothing there counts; the next run deletes it."""


def replace(system: fs.FileSystem, made: str, target: str) -> None:
    """Move a file to its place; some file systems do not replace one that is there."""
    try:
        system.move(made, target)
    except OSError:
        if system.get_file_info(target).type != fs.FileType.File:
            raise
        system.delete_file(target)
        system.move(made, target)


def write_text_folders(rows: DataFrame, path: str, names: list[str], order: list[str], partitions: int | None = None) -> None:
    """Write lines (names, order, value) as one text file per name; deletes what is at ``path``."""
    spark = rows.sparkSession
    spark.dataSource.register(TextFolders)
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    dealt = rows.repartition(partitions, *names) if partitions else rows.repartition(*names)
    (dealt.sortWithinPartitions(*names, *order)
     .select(*names, *[F.col(c).cast("string").alias(f"__text_{c}") for c in names], "value")
     .write.format("text_folders").option("path", path).mode("append").save())


def read_text_folders(spark: SparkSession, path: str) -> DataFrame:
    """(names, value): all lines, by the index of the files, which tasks read; no folder is listed."""
    system, folder = file_system(path)
    if system.get_file_info(f"{folder}/_SUCCESS").type != fs.FileType.File:
        raise FileNotFoundError(f"no finished texts in {path}")
    index = spark.read.parquet(os.path.join(path, _INDEX))
    names = [f for f in index.schema if f.name != "__place"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        for batch in batches:
            at: list[int] = []
            lines: list[str] = []
            for i, place in enumerate(batch.column(len(names)).to_pylist()):
                with system.open_input_stream(f"{folder}/{place}/{_FILE}") as file:
                    own = file.read().decode().split("\n")[:-1]
                at += [i] * len(own)
                lines += own
                if len(lines) >= _READ_ROWS or i == batch.num_rows - 1:
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(rows) for f in names], pa.array(lines, pa.string())],
                                                     names=[*[f.name for f in names], "value"])
                    at, lines = [], []

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(width, *[f.name for f in names]).mapInArrow(
        read, T.StructType([*names, T.StructField("value", T.StringType())]))
