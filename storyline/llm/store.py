"""Small binary files in the shared folder, by any path that Arrow's file systems know."""
from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as fs


def local_path(path: str) -> str | None:
    """The path in this machine's file tree (a mounted shared folder), if it is one."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def put(path: str, data: bytes) -> None:
    """Write the file whole; an interrupted writer leaves no file under this name."""
    local = local_path(path)
    if local is None:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_output_stream(name) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{os.getpid()}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, local)


def get(path: str) -> bytes:
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            return file.read()
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as file:
        return file.read()


def mapped(path: str, dtype) -> np.ndarray:
    """The file as an array: mapped into memory where it is in a mounted folder, else read."""
    local = local_path(path)
    if local is None:
        return np.frombuffer(get(path), dtype)
    return np.memmap(local, dtype, "r") if os.path.getsize(local) else np.zeros(0, dtype)
