"""Small files written and read by tasks on any store that Python can reach.

Writes go to a private name and are renamed, so that a task which runs twice
(a lost executor, speculation) leaves one whole file under the final name.
"""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import urlparse


def _local(path: str) -> str | None:
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return u.path
    return None


def write_bytes(path: str, parts) -> None:
    """``parts``: an iterable of bytes-like chunks."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        tmp = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(tmp, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    tmp = f"{inner}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as f:
        for p in parts:
            f.write(p)
    store.move(tmp, inner)


def read_range(path: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start``; random access without reading the rest."""
    local = _local(path)
    if local is not None:
        with open(local, "rb") as f:
            f.seek(start)
            return f.read(length)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return f.read_at(length, start)


def read_bytes(path: str) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def remove_tree(path: str) -> None:
    """Remove a folder that tasks wrote, if it's there."""
    local = _local(path)
    if local is not None:
        shutil.rmtree(local, ignore_errors=True)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)
