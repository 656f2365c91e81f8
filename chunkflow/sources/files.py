"""Whole files, written at once, on mounted folders and on file systems that pyarrow knows."""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from urllib.parse import urlparse


def local(path: str | Path) -> Path | None:
    """The path on a mounted file system, or None."""
    u = urlparse(str(path))
    return Path(u.path if u.scheme else str(path)) if u.scheme in ("", "file") else None


def _remote(path: str | Path):
    from pyarrow import fs

    return fs.FileSystem.from_uri(str(path))


def write_atomic(path: str | Path, data: str | bytes) -> None:
    """The file appears whole or not at all; its folder is made. Attempts that write it at once do not meet."""
    data, part = data.encode("utf-8") if isinstance(data, str) else data, f".{uuid.uuid4().hex}.tmp"
    at = local(path)
    if at is None:
        store, name = _remote(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        with store.open_output_stream(name + part) as f:
            f.write(data)
        store.move(name + part, name)
        return
    at.parent.mkdir(parents=True, exist_ok=True)
    temporary = at.with_name(at.name + part)
    temporary.write_bytes(data)
    os.replace(temporary, at)


def read_if_there(path: str | Path) -> bytes | None:
    at = local(path)
    try:
        if at is not None:
            return at.read_bytes()
        store, name = _remote(path)
        with store.open_input_stream(name) as f:
            return f.read()
    except FileNotFoundError:
        return None


def remove_if_there(path: str | Path) -> None:
    at = local(path)
    try:
        if at is not None:
            at.unlink()
        else:
            store, name = _remote(path)
            store.delete_file(name)
    except FileNotFoundError:
        pass
