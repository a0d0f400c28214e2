"""A stream of the lines that are added to log files, by file and byte."""
from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL_BYTES = 512 * 1024     # fixed value: most bytes of a log per poll
_LOOK_BACK = 64 * 1024


class Piece(InputPartition):
    """Whole lines of one file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LogTail(DataSource):
    """Format ``log_tail``; options ``path`` (a file, a folder or a pattern), ``positions`` and ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> "TailReader":
        return TailReader(self.options["path"], self.options["positions"], int(self.options.get("max_bytes", TAIL_BYTES)))


class TailReader(DataSourceStreamReader):
    """Offsets are ``{file: {"life": n, "at": byte}}``.

    ``life`` counts how often a file was found shorter than it had been read: it was
    written anew then, and is read from its start.  A batch ends after a line end in
    every file, so a line that is still being written waits.

    Spark does not tell a restarted reader where it stands before it asks for the
    next end.  So an end is kept in ``positions`` before Spark gets to know it: what
    is kept there is never behind the checkpoint, and one portion ahead at most.
    """

    def __init__(self, path: str, positions: str, max_bytes: int):
        self.path, self.positions, self.max_bytes = path, positions, max_bytes
        self.known: dict[str, dict] | None = None

    # ---- files ----

    @staticmethod
    def _system(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")

    def _sizes(self) -> dict[str, int]:
        system, path = self._system(self.path)
        folder, pattern = path, "*"
        if any(c in os.path.basename(path) for c in "*?["):
            folder, pattern = os.path.split(path)
        elif system.get_file_info(path).type == fs.FileType.File:
            return {path: system.get_file_info(path).size}
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)
                and not f.base_name.startswith((".", "_"))}

    def _line_end(self, system: fs.FileSystem, path: str, start: int, size: int, room: int) -> int:
        """The end of the last whole line within ``room`` bytes, or of the first line if that is longer; else ``start``."""
        with system.open_input_file(path) as file:
            high = min(size, start + room)
            while high > start:
                low = max(start, high - _LOOK_BACK)
                file.seek(low)
                at = file.read(high - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
            at = start + room
            while at < size:
                file.seek(at)
                found = file.read(_LOOK_BACK).find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += _LOOK_BACK
        return start

    # ---- offsets ----

    def initialOffset(self) -> dict:
        return {}

    def _resume(self) -> dict[str, dict]:
        system, folder = self._system(self.positions)
        try:
            with system.open_input_stream(f"{folder}/position.json") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return {}

    def _keep(self, end: dict) -> None:
        system, folder = self._system(self.positions)
        system.create_dir(folder)
        with system.open_output_stream(f"{folder}/position.part") as file:
            file.write(json.dumps(end).encode())
        system.move(f"{folder}/position.part", f"{folder}/position.json")

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self._resume()
        known = {path: dict(entry) for path, entry in self.known.items()}
        system, _ = self._system(self.path)
        for path, size in sorted(self._sizes().items()):
            entry = known.setdefault(path, {"life": 0, "at": 0})
            if size < entry["at"]:
                entry["life"], entry["at"] = entry["life"] + 1, 0
            if size > entry["at"]:      # every file goes on by a portion of its own, which is a task
                entry["at"] = self._line_end(system, path, entry["at"], size, self.max_bytes)
        if known != self.known:
            self._keep(known)
            self.known = known
        return known

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for path, new in end.items():
            old = start.get(path, {"life": 0, "at": 0})
            begin = old["at"] if old["life"] == new["life"] else 0
            if new["at"] > begin:
                pieces.append(Piece(path, begin, new["at"]))
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        system, _ = self._system(self.path)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.start)
            data = file.read(partition.end - partition.start)
        at = partition.start
        for line in data.split(b"\n")[:-1]:     # a piece ends with a line end
            yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1
