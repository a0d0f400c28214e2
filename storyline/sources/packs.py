"""Many small text files in few large ones, with an index of where each begins.

A pack holds the files of up to a thousand segments one after another, and beside it
lies a parquet file with the place and length of each.  ``manifest.json`` names the
packs that count; it is replaced in one step when all tasks are done.  What lost or
failed attempts have written is in no manifest, and is deleted with the next one.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PACK_FILES = 1000
PACK_BYTES = 64 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass
class Written(WriterCommitMessage):
    packs: list[str]


class TextPacks(DataSource):
    """Format ``text_packs``: rows (names ..., value) that come ordered by name; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "text_packs"

    def writer(self, schema, overwrite: bool) -> "PackWriter":
        return PackWriter(self.options["path"], overwrite, int(self.options.get("files", PACK_FILES)))


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, files: int):
        self.path, self.overwrite, self.files, self.run = path, overwrite, files, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(f"{path}/packs")
        task = TaskContext.get()
        stem = f"{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}"
        packs: list[str] = []
        names: list[tuple] = []
        spans: list[list[int]] = []
        out, at, schema = None, 0, None

        def close() -> None:
            nonlocal out, at
            if out is None:
                return
            out.close()
            columns = [pa.array(c, f.type) for c, f in zip(zip(*names), schema)]
            index = pa.table([*columns, pa.array([packs[-1]] * len(names)), pa.array([s[0] for s in spans], pa.int64()),
                              pa.array([s[1] for s in spans], pa.int64())], names=[*[f.name for f in schema], "pack", "at", "size"])
            with system.open_output_stream(f"{path}/packs/{packs[-1]}.parquet") as file:
                pq.write_table(index, file)
            names.clear()
            spans.clear()
            out, at = None, 0

        for batch in iterator:
            schema = list(batch.schema)[:-1]
            columns = [batch.column(i).to_pylist() for i in range(len(schema))]
            for name, line in zip(zip(*columns), batch.column(len(schema)).to_pylist()):
                if not names or name != names[-1]:
                    if len(names) >= self.files or at >= PACK_BYTES:
                        close()
                    if out is None:
                        packs.append(f"{stem}-{len(packs):04d}")
                        out = system.open_output_stream(f"{path}/packs/{packs[-1]}.txt")
                    names.append(name)
                    spans.append([at, 0])
                data = (line + "\n").encode()
                out.write(data)
                spans[-1][1] += len(data)
                at += len(data)
        close()
        return Written(packs)

    def _packs(self, keep) -> None:
        """Delete all files of packs but those to keep."""
        system, path = file_system(self.path)
        for info in system.get_file_info(fs.FileSelector(f"{path}/packs", allow_not_found=True)):
            if not keep(info.base_name.split(".")[0]):
                system.delete_file(info.path)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        packs = [p for m in messages if m is not None for p in m.packs]
        if not self.overwrite:
            packs = listed(self.path) + packs
        system.create_dir(path)
        with system.open_output_stream(f"{path}/manifest.part") as file:
            file.write(json.dumps(packs).encode())
        system.move(f"{path}/manifest.part", f"{path}/manifest.json")
        keep = set(packs)
        self._packs(lambda stem: stem in keep)

    def abort(self, messages: list[Written | None]) -> None:
        self._packs(lambda stem: not stem.startswith(self.run))


def listed(path: str) -> list[str]:
    """The packs that count."""
    system, folder = file_system(path)
    try:
        with system.open_input_stream(f"{folder}/manifest.json") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return []


def write_text_packs(rows: DataFrame, path: str, names: list[str], order: list[str], files: int = PACK_FILES,
                     partitions: int | None = None) -> None:
    """Write lines (names, order, value) as one text per name; replaces what is at ``path`` in one step."""
    rows.sparkSession.dataSource.register(TextPacks)
    dealt = rows.repartition(partitions, *names) if partitions else rows.repartition(*names)
    (dealt.sortWithinPartitions(*names, *order).select(*names, "value")
     .write.format("text_packs").options(path=path, files=files).mode("overwrite").save())


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """(names, pack, at, size) of every text."""
    system, folder = file_system(path)
    packs = listed(path)
    if not packs:
        raise FileNotFoundError(f"no manifest of packs in {path}")
    return spark.read.parquet(*[f"{path.rstrip('/')}/packs/{p}.parquet" for p in packs])


def read_texts(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """(names, value): the texts of an index, all of them by default; only their bytes are read."""
    index = read_text_index(spark, path) if index is None else index
    names = [f for f in index.schema if f.name not in ("pack", "at", "size")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        file, opened = None, None
        for batch in batches:
            texts = []
            for pack, at, size in zip(*[batch.column(c).to_pylist() for c in ("pack", "at", "size")]):
                if pack != opened:
                    if file is not None:
                        file.close()
                    file, opened = system.open_input_file(f"{folder}/packs/{pack}.txt"), pack
                file.seek(at)
                texts.append(file.read(size).decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in names], pa.array(texts, pa.string())],
                                             names=[*[f.name for f in names], "value"])

    return index.mapInArrow(read, T.StructType([*names, T.StructField("value", T.StringType())]))
